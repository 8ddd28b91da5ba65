"""The production table of all features, checks of its keys and contract, and checks of what is made from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.functions.physics import parse_bool
from roadlens.operators import features as f
from roadlens.operators.continuity import KEYS, segment_window, step_of
from roadlens.operators.starts import start_episodes
from roadlens.sources.scratch import written

# Names of the table's columns, in order, and its versions.
CONTEXT = ("dt_seconds", "thermal_state", "child_state", "operating_state", "condition_confidence", "condition_quality_flags")
SIGNALS = ("coolant_temp", "map", "rpm", "speed", "intake_temp", "maf", "tps", "ambient_temp", "accel_pedal_d", "accel_pedal_e")
ATOMIC = ("segment_gap_seconds", "coolant_ambient_delta", "intake_ambient_delta", "accel_pedal_mean", "accel_pedal_channel_delta", "pedal_slope", "rpm_slope", "engine_on_flag")
CALIBRATED = ("speed_density_maf_residual", "pedal_mapping_residual")
START = ("engine_start_observed", "engine_start_episode_id", "elapsed_since_engine_start", "ect_start", "aat_start", "iat_start")
WINDOWS = {
    "maf_integral_180s": "maf_integral", "ect_rate_180s": "ect_rate", "intake_temp_stability": "intake_temp_stability", "speed_std_120s": "speed_std", "maf_std_120s": "maf_std",
    "rpm_std_120s": "rpm_std", "accel_pedal_mean_std_120s": "accel_pedal_mean_std", "map_range_60s": "map_range",
}
SCHEMA_VERSION, CALIBRATION_VERSION = "feature_schema.v1", "calibration.v1"
COLUMNS = ("timestamp", "trip_id", "segment_id", "row_in_segment", *CONTEXT, *SIGNALS, *ATOMIC, *CALIBRATED, *START, *WINDOWS, "schema_version", "calibration_version")


def production_table(df: DataFrame, episodes: DataFrame | None = None, **lengths: int) -> DataFrame:
    """All ``COLUMNS`` of the samples ``df`` (with flags and states, or with features already): features in one plan, an episode's start joined to its own sample and carried on to those after it.

    Where ``df`` is dealt out by segment (``written_by``), only episodes and segments are dealt out, a row each. Upstream key sets cannot differ, since all features come from the samples themselves. The gap before a
    segment stands on its first row. ``timestamp`` is whole seconds of UTC.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    episodes = written(start_episodes(df), "episodes") if episodes is None else episodes  # as files they have no partitioning that the samples would be dealt out to
    about = F.struct("episode_id", "end_row", F.col("start_t").alias("t"), "ect_start", "aat_start", "iat_start").alias("_start")
    starts = episodes.select("trip_id", "segment_id", F.col("start_row").alias("row_in_segment"), about)
    made = df if "whole_block" in df.columns else f.production(df, **lengths)
    made = made.join(starts, list(KEYS), "left").withColumn("_of", F.last("_start", True).over(segment_window().rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("row_in_segment") <= F.col("_of.end_row")
    pick = lambda x: F.when(inside, x)
    made = made.withColumns(
        {
            "engine_start_observed": F.col("_start").isNotNull(), "engine_start_episode_id": pick(F.col("_of.episode_id")), "elapsed_since_engine_start": pick((F.col("t") - F.col("_of.t")).cast("double")),
            **{x: pick(F.col(f"_of.{x}")) for x in ("ect_start", "aat_start", "iat_start")},
        }
    ).join(step_of(df), ["trip_id", "segment_id"])
    named = {"timestamp": F.col("t"), "dt_seconds": F.lit(1.0), "segment_gap_seconds": F.when(F.col("row_in_segment") == F.col("first_row"), F.col("gap_seconds"))}
    named |= {n: F.col(c) for n, c in WINDOWS.items()} | {"schema_version": F.lit(SCHEMA_VERSION), "calibration_version": F.lit(CALIBRATION_VERSION)}
    if "condition_quality_flags" not in df.columns:
        named["condition_quality_flags"] = F.lit("OK")
    return made.select(*[named.get(c, F.col(c)).alias(c) for c in COLUMNS])


@dataclass(frozen=True)
class Field:
    """What a column of the table must be: its type, whether it may be null, the values it may take, or the one it must have."""

    name: str
    kind: str
    nullable: bool = True
    domain: tuple[str, ...] | None = None
    constant: object = None


# What each column may hold.
THERMAL, CHILD, CONFIDENCE = ("warmup", "post_warmup"), ("idle", "steady_driving", "acceleration", "high_load"), ("high", "medium", "low")
_REQUIRED = {
    "timestamp": "bigint", "trip_id": "string", "segment_id": "string", "row_in_segment": "int", "dt_seconds": "double", "condition_quality_flags": "string", "engine_start_observed": "boolean",
}
_NAMED = {
    "thermal_state": Field("thermal_state", "string", False, THERMAL), "child_state": Field("child_state", "string", False, CHILD), "condition_confidence": Field("condition_confidence", "string", False, CONFIDENCE),
    "operating_state": Field("operating_state", "string", False, tuple(f"{t}__{c}" for t in THERMAL for c in CHILD)), "dt_seconds": Field("dt_seconds", "double", False, None, 1.0), "engine_on_flag": Field("engine_on_flag", "boolean"),
    "engine_start_episode_id": Field("engine_start_episode_id", "string"), "schema_version": Field("schema_version", "string", False, None, SCHEMA_VERSION), "calibration_version": Field("calibration_version", "string", False, None, CALIBRATION_VERSION),
}
CONTRACT = tuple(_NAMED.get(c) or Field(c, _REQUIRED.get(c, "double"), c not in _REQUIRED) for c in COLUMNS)


def contract_faults(df: DataFrame, contract: tuple[Field, ...] = CONTRACT) -> DataFrame:
    """(rule, column, faults): a row for every rule of ``contract`` that the table breaks, none for a sound one.

    Rules of the schema, told without reading: ``missing``, ``unexpected``, ``order`` (position of the first column out
    of place) and ``type`` where the column's type is not the contract's and does not hold its values as text. Rules of rows,
    one aggregate for all: ``type`` (values that do not parse), ``null``, ``domain``, ``constant``; and ``key_null`` and
    ``key_twice``, rows whose key repeats. A text column may stand for another type: its values are parsed.
    """
    spark, held = df.sparkSession, dict(df.dtypes)
    names, have = [f.name for f in contract], df.columns
    schema = [("missing", n, 1) for n in names if n not in held] + [("unexpected", n, 1) for n in have if n not in names]
    common, expected = [n for n in have if n in names], [n for n in names if n in held]
    schema += [("order", n, have.index(n) + 1) for n, want in zip(common, expected) if n != want][:1]
    rows: dict[tuple[str, str], Column] = {}
    for f in contract:
        if f.name not in held:
            continue
        raw = F.col(f"`{f.name}`")
        if held[f.name] != f.kind and held[f.name] != "string":
            schema.append(("type", f.name, 1))
            continue
        value = raw
        if held[f.name] != f.kind:
            value = parse_bool(raw) if f.kind == "boolean" else raw.try_cast(f.kind)
            if f.kind in ("int", "bigint"):
                value = F.when(raw.try_cast("double") % 1 == 0, raw.try_cast("double").try_cast(f.kind))
            rows["type", f.name] = raw.isNotNull() & value.isNull()
        if not f.nullable:
            rows["null", f.name] = raw.isNull()
        if f.domain is not None:
            rows["domain", f.name] = raw.isNotNull() & ~value.isin(*f.domain)
        if f.constant is not None:
            rows["constant", f.name] = ~value.eqNullSafe(F.lit(f.constant))
    told = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rows.values())]
    cells = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column"), F.col(f"r{i}").alias("faults")) for i, (rule, name) in enumerate(rows)])
    out = spark.createDataFrame(schema, "rule string, column string, faults long")
    if told:
        out = out.unionByName(df.agg(*told).select(F.explode(cells).alias("c")).select("c.*"))
    if all(c in held for c in KEYS):
        twice = df.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("faults"))
        out = out.unionByName(twice.select(F.lit("key_twice").alias("rule"), F.lit(",".join(KEYS)).alias("column"), "faults"))
    return out.where("faults > 0")


def episode_key_faults(context: DataFrame, episodes: DataFrame) -> DataFrame:
    """(rule, faults): episode keys that repeat, samples of unknown episodes, samples whose start values differ from their episode's, episodes without exactly one observed start, observed starts of no episode."""
    drifted = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ("ect_start", "aat_start", "iat_start")])
    own = episodes.groupBy("trip_id", "episode_id").agg(F.count("*").alias("n"), *[F.first(c).alias(f"e_{c}") for c in ("ect_start", "aat_start", "iat_start")])
    j = context.join(own.withColumnsRenamed({"trip_id": "e_trip", "episode_id": "e_id"}), (F.col("trip_id") == F.col("e_trip")) & (F.col("engine_start_episode_id") == F.col("e_id")), "left")
    named = F.col("engine_start_episode_id").isNotNull()
    a = j.agg(
        F.count_if(named & F.col("e_id").isNull()).alias("orphan"), F.count_if(F.col("e_id").isNotNull() & drifted).alias("drifted"), F.count_if(F.col("engine_start_observed") & ~named).alias("observed_without_episode")
    )
    seen = context.where("engine_start_observed").groupBy(F.col("trip_id").alias("c_trip"), F.col("engine_start_episode_id").alias("c_id")).agg(F.count("*").alias("starts"))
    b = own.join(seen, (F.col("trip_id") == F.col("c_trip")) & (F.col("episode_id") == F.col("c_id")), "left").agg(
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.coalesce("starts", F.lit(0)) != 1).alias("not_one_start")
    )
    both = a.crossJoin(b)  # one row each
    return both.unpivot([], both.columns, "rule", "faults")


def provenance_faults(df: DataFrame) -> dict[str, Column]:
    """Conditions that every sample must meet: versions, step, and the form of the combined state."""
    state = F.col("operating_state")
    return {
        "schema_version": F.col("schema_version") == SCHEMA_VERSION, "calibration_version": F.col("calibration_version") == CALIBRATION_VERSION, "dt_is_one": F.col("dt_seconds") == 1.0,
        "state_form": ~F.startswith(state, F.lit("post_warmup_")) | F.startswith(state, F.lit("post_warmup__")),
    }


def output_faults(levels: tuple[str, ...] = ("Low", "Medium", "High"), types: tuple[str, ...] = tuple(k.PRIORITY_SIGNALS)) -> Column:
    """Array of what is wrong with a window-risk record, in fixed order; empty for a sound one. Nulls are faults."""
    two, signals = F.col("secondary_risk"), F.col("key_signals")
    unit = lambda x: F.coalesce(x.between(0, 1), F.lit(False))
    level = F.when(F.col("risk_score") >= k.RISK_HIGH, "High").when(F.col("risk_score") >= k.RISK_MEDIUM, "Medium").otherwise("Low")
    sound = {
        "anomaly_type": F.col("anomaly_type").isin(*types), "risk_score": unit(F.col("risk_score")), "risk_level": F.col("risk_level").isin(*levels) & (F.col("risk_level") == level),
        "prediction_confidence": unit(F.col("prediction_confidence")), "key_signals": (F.size(signals) >= 1) & (F.size(signals) <= 5),
        "signal_value": ~F.exists(signals, lambda x: x["value"].isNull() | x["feature"].isNull()), "signal_range": ~F.exists(signals, lambda x: F.coalesce((F.size(x["reference_range"]) != 2) | (F.get(x["reference_range"], F.lit(0)) > F.get(x["reference_range"], F.lit(1))), F.lit(True))),
        "signal_twice": F.size(F.array_distinct(F.transform(signals, lambda x: x["feature"]))) == F.size(signals), "secondary_type": two["anomaly_type"] != F.col("anomaly_type"), "secondary_order": two["risk_score"] <= F.col("risk_score"),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in sound.items()]))


def decision_faults() -> dict[str, Column]:
    """Conditions that every decision row must meet."""
    result, role = F.col("result_state"), F.col("decision_role")
    return {
        "result_state": result.isin("triggered", "pass", "not_evaluable", "pending"), "decision_role": role.isin("verdict", "support", "arbitration_evidence", "pending_precursor"),
        "emitted_is_verdict": ~F.col("dtc_emitted") | ((role == "verdict") & (result == "triggered")), "emitted_has_code": ~F.col("dtc_emitted") | F.col("routed_dtc").isNotNull(), "trip": F.col("trip_id").isNotNull(),
    }
