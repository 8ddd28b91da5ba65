"""SQL fragments that the oracles share."""

from __future__ import annotations

from roadlens.sources.adapters import IRREGULAR_SQL, TICKS_SQL

SEG = "PARTITION BY trip_id, segment_id ORDER BY row_in_segment"
BLK = "PARTITION BY trip_id, segment_id, block ORDER BY row_in_segment"
KEYS = "trip_id, segment_id, row_in_segment"


def valid_sql(*signals: str) -> str:
    parts = []
    for s in signals:
        parts.append(f"{s} IS NOT NULL")
        parts += [f"{s}_{f} IS NOT DISTINCT FROM FALSE" for f in ("is_imputed", "is_suspicious", "had_hard_invalid_source")]
    return "(" + " AND ".join(parts) + ")"


def blocks(*signals: str, src: str = "ticks", out: str = "blk") -> str:
    """CTEs that end in ``out``: ``src`` with ok, cont and block."""
    return f"""{out}_v AS (SELECT *, coalesce({valid_sql(*signals)}, FALSE) AS ok FROM {src}),
{out}_p AS (SELECT *, lag(ok) OVER ({SEG}) AS p_ok, lag(t) OVER ({SEG}) AS p_t, lag(row_in_segment) OVER ({SEG}) AS p_r FROM {out}_v),
{out}_c AS (SELECT *, coalesce(ok AND p_ok AND row_in_segment - p_r = 1 AND t - p_t = 1, FALSE) AS cont FROM {out}_p),
{out} AS (SELECT *, CASE WHEN ok THEN CAST(sum(CASE WHEN ok AND NOT cont THEN 1 ELSE 0 END) OVER ({SEG}) AS BIGINT) END AS block FROM {out}_c)"""


def runs(condition: str, src: str = "blk", out: str = "run_t", name: str = "run") -> str:
    """CTEs that end in ``out``: ``src`` with the run number of true ``condition`` in the block."""
    return f"""{out}_h AS (SELECT *, block IS NOT NULL AND coalesce({condition}, FALSE) AS held FROM {src}),
{out}_s AS (SELECT *, CASE WHEN held AND NOT coalesce(lag(held) OVER ({BLK}), FALSE) THEN 1 ELSE 0 END AS starts FROM {out}_h),
{out} AS (SELECT *, CASE WHEN held THEN CAST(sum(starts) OVER ({BLK}) AS BIGINT) END AS {name} FROM {out}_s)"""


def with_ticks(*ctes: str) -> str:
    return "WITH " + ",\n".join([TICKS_SQL, *ctes]) + "\n"


def with_irregular(*ctes: str) -> str:
    return "WITH " + ",\n".join([IRREGULAR_SQL, *ctes]) + "\n"


def named_blocks(valid: dict[str, str], src: str, out: str) -> str:
    """CTEs that end in ``out``: ``src`` with a block number for each condition of ``valid``."""
    oks = ", ".join(f"coalesce({v}, FALSE) AS ok_{b}" for b, v in valid.items())
    lags = ", ".join(f"lag(ok_{b}) OVER ({SEG}) AS p_{b}" for b in valid)
    step = "row_in_segment - lag_r = 1 AND t - lag_t = 1"
    nums = ", ".join(f"CASE WHEN ok_{b} THEN CAST(sum(CASE WHEN ok_{b} AND NOT coalesce(p_{b} AND {step}, FALSE) THEN 1 ELSE 0 END) OVER ({SEG}) AS BIGINT) END AS {b}" for b in valid)
    return f"""{out}_a AS (SELECT *, {oks} FROM {src}),
{out}_b AS (SELECT *, lag(row_in_segment) OVER ({SEG}) AS lag_r, lag(t) OVER ({SEG}) AS lag_t, {lags} FROM {out}_a),
{out} AS (SELECT * EXCLUDE (lag_r, lag_t), {nums} FROM {out}_b)"""


def by(block: str, n: int | None = None) -> str:
    frame = f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if n else ""
    return f"(PARTITION BY trip_id, segment_id, {block} ORDER BY row_in_segment{frame})"


def _roll(fn: str, n: int, block: str) -> str:
    return f"CASE WHEN {block} IS NOT NULL AND count(*) OVER {by(block, n)} = n THEN {fn} END".replace("= n", f"= {n}")


def production_sql(span: int, long: int, short: int) -> str:
    """CTEs that end in ``prod``: ticks with operating_state and all features."""
    sd = "(-14.688826051927967 + 0.023778032668470294 * least(greatest(map * rpm / (intake_temp + 273.15), 293.93209175000004), 1516.36693525) + 0.14127609145896305 * least(greatest(map, 94.0), 203.0) + 6.690047685838753e-05 * least(greatest(rpm, 877.0), 2205.0) + 0.07101467711912292 * least(greatest(intake_temp, -8.0), 40.0))"
    pedal = valid_sql("accel_pedal_d", "accel_pedal_e")
    sloped = lambda c, b: f"CASE WHEN {b} IS NOT NULL THEN ({c} - lag({c}) OVER {by(b)}) / (t - lag(t) OVER {by(b)}) END"
    whole = lambda b, v: f"CASE WHEN {b} IS NOT NULL AND t - lag(t, {span}) OVER {by(b)} = {span} THEN {v} END"
    blocks_of = {f"{s}_block": valid_sql(s) for s in ("maf", "coolant_temp", "intake_temp", "speed", "map", "rpm")} | {"pedal_block": "accel_pedal_mean IS NOT NULL"}
    std = lambda c, n, b: _roll(f"stddev_samp({c}) OVER {by(b, n)}", n, b)
    return f"""atom AS (SELECT *, thermal_state || '__' || child_state AS operating_state,
 CASE WHEN {valid_sql("rpm")} THEN rpm >= 50 END AS engine_on_flag,
 CASE WHEN {valid_sql("coolant_temp", "ambient_temp")} THEN coolant_temp - ambient_temp END AS coolant_ambient_delta,
 CASE WHEN {valid_sql("intake_temp", "ambient_temp")} THEN intake_temp - ambient_temp END AS intake_ambient_delta,
 CASE WHEN {pedal} THEN (accel_pedal_d + accel_pedal_e) / 2 END AS accel_pedal_mean,
 CASE WHEN {pedal} THEN abs(accel_pedal_d - accel_pedal_e) END AS accel_pedal_channel_delta,
 CASE WHEN {valid_sql("maf", "map", "rpm", "intake_temp")} THEN maf - {sd} END AS speed_density_maf_residual,
 CASE WHEN {pedal} THEN accel_pedal_e - (0.997273 * accel_pedal_d + 0.383103) END AS pedal_mapping_residual FROM ticks),
{named_blocks(blocks_of, "atom", "fb0")},
fb1 AS (SELECT *, rpm >= 50 AND max(CASE WHEN rpm < 50 THEN row_in_segment END) OVER (PARTITION BY trip_id, segment_id, rpm_block ORDER BY row_in_segment) IS NOT NULL AND rpm_block IS NOT NULL AS started FROM fb0),
{named_blocks({"maf_start_block": valid_sql("maf") + " AND started"}, "fb1", "fb")},
prod AS (SELECT *, {sloped("accel_pedal_mean", "pedal_block")} AS pedal_slope, {sloped("rpm", "rpm_block")} AS rpm_slope,
 {whole("maf_start_block", f"sum(maf) OVER {by('maf_start_block', span + 1)} - (maf + lag(maf, {span}) OVER {by('maf_start_block')}) / 2")} AS maf_integral,
 {whole("coolant_temp_block", f"(coolant_temp - lag(coolant_temp, {span}) OVER {by('coolant_temp_block')}) / ({span} / 60)")} AS ect_rate,
 {std("intake_temp", short, "intake_temp_block")} AS intake_temp_stability, {std("speed", long, "speed_block")} AS speed_std,
 {std("maf", long, "maf_block")} AS maf_std, {std("rpm", long, "rpm_block")} AS rpm_std,
 {_roll(f"max(map) OVER {by('map_block', short)} - min(map) OVER {by('map_block', short)}", short, "map_block")} AS map_range,
 {std("accel_pedal_mean", long, "pedal_block")} AS accel_pedal_mean_std FROM fb)"""


def tidy_sql(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(32, 9)), {digits}) AS DOUBLE)"
