"""The atomic, window and calibrated features of a sample, in one plan without joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.functions.physics import maf_residual, pedal_residual
from roadlens.operators.continuity import KEYS, blocks_of, depth, ok, segment_window, with_quality
from roadlens.operators.rolling import rolling_range, rolling_std, span_rate, trapezoid


def atomic(df: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with engine_on_flag, temperature and pedal differences and slopes; each is null where a signal of it is not quality valid.

    Blocks come with them: of each signal, of whatever quality (``whole_block``) and of air flow inside one engine start (``maf_start_block``).
    ``also`` are windows over the segment, worked out in the same pass.
    """
    df = df if "rpm_ok" in df.columns else with_quality(df)
    pedal = ok(["accel_pedal_d", "accel_pedal_e"])
    df = df.withColumns(
        {
            "engine_on_flag": F.when(ok(["rpm"]), F.col("rpm") >= k.ENGINE_ON_RPM),
            "coolant_ambient_delta": F.when(ok(["coolant_temp", "ambient_temp"]), F.col("coolant_temp") - F.col("ambient_temp")),
            "intake_ambient_delta": F.when(ok(["intake_temp", "ambient_temp"]), F.col("intake_temp") - F.col("ambient_temp")),
            "accel_pedal_mean": F.when(pedal, (F.col("accel_pedal_d") + F.col("accel_pedal_e")) / 2),
            "accel_pedal_channel_delta": F.when(pedal, F.abs(F.col("accel_pedal_d") - F.col("accel_pedal_e"))),
        }
    )
    w, row, on = segment_window(), F.col("row_in_segment"), F.col("rpm") >= k.ENGINE_ON_RPM
    valid = {"pedal_block": F.col("accel_pedal_mean").isNotNull()} | {f"{s}_block": ok([s]) for s in ("rpm", "maf", "coolant_temp", "intake_temp", "speed", "map")}
    before = {f"_{c}_last": F.lag(c).over(w) for c in ("accel_pedal_mean", "rpm")} | {"_off_row": F.max(F.when(ok(["rpm"]) & ~on, row)).over(w)}
    df = blocks_of(df, valid | {"whole_block": F.lit(True), "firing_block": ok(["maf", "rpm"]) & on}, before | (also or {}))
    # the engine was seen to turn on inside the block of its speed: an episode; that holds for all or none of a block in which it fires
    started = F.col("_off_row") >= F.col("rpm_block_start")
    change = lambda c, block: F.when(depth(block) >= 1, F.col(c) - F.col(f"_{c}_last"))  # noqa: E731  # a second, in a block
    df = df.withColumns(
        {
            "pedal_slope": change("accel_pedal_mean", "pedal_block"), "rpm_slope": change("rpm", "rpm_block"),
            "maf_start_block": F.when(started, F.col("firing_block")), "maf_start_block_start": F.when(started, F.col("firing_block_start")),
        }
    )
    return df.drop(*before, "firing_block", "firing_block_start")


def calibrated(df: DataFrame) -> DataFrame:
    """``df`` with speed_density_maf_residual and pedal_mapping_residual."""
    air = ok(["maf", "map", "rpm", "intake_temp"])
    c = F.col
    return df.withColumns(
        {
            "speed_density_maf_residual": F.when(air, maf_residual(c("maf"), c("map"), c("rpm"), c("intake_temp"))),
            "pedal_mapping_residual": F.when(ok(["accel_pedal_d", "accel_pedal_e"]), pedal_residual(c("accel_pedal_d"), c("accel_pedal_e"))),
        }
    )


def _windows(span: int, long: int, short: int) -> dict[str, tuple[Column, str, int]]:
    """(window over the segment, block, rows of the block that it looks back) of each strict-window feature."""
    return {
        "maf_integral": (trapezoid("maf", span, None), "maf_start_block", span),
        "ect_rate": (span_rate("coolant_temp", span, None), "coolant_temp_block", span),
        "intake_temp_stability": (rolling_std("intake_temp", short, None), "intake_temp_block", short - 1),
        "speed_std": (rolling_std("speed", long, None), "speed_block", long - 1),
        "maf_std": (rolling_std("maf", long, None), "maf_block", long - 1),
        "rpm_std": (rolling_std("rpm", long, None), "rpm_block", long - 1),
        "map_range": (rolling_range("map", short, None), "map_block", short - 1),
        "accel_pedal_mean_std": (rolling_std("accel_pedal_mean", long, None), "pedal_block", long - 1),
    }


def production(df: DataFrame, *, span: int = 180, long: int = 120, short: int = 60) -> DataFrame:
    """All features of a sample: keys, state and 20 features.

    Strict windows are each on blocks of their own signal, the integral inside one engine start besides; lengths are parameters.
    They are worked out in one pass with the neighbours that tell the blocks, a second one gives the blocks: two windows in all.
    """
    windows = _windows(span, long, short)
    df = calibrated(atomic(df, {f"_{n}_seen": value for n, (value, *_) in windows.items()}))
    df = df.withColumns({n: F.when(depth(block) >= rows, F.col(f"_{n}_seen")) for n, (_, block, rows) in windows.items()})
    return df.drop(*[f"_{n}_seen" for n in windows])


FEATURES = (
    "engine_on_flag", "coolant_ambient_delta", "intake_ambient_delta", "accel_pedal_mean", "accel_pedal_channel_delta", "pedal_slope", "rpm_slope",
    "speed_density_maf_residual", "pedal_mapping_residual", "maf_integral", "ect_rate", "intake_temp_stability", "speed_std", "maf_std", "rpm_std",
    "map_range", "accel_pedal_mean_std",
)
__all__ = ["FEATURES", "KEYS", "atomic", "calibrated", "production"]
