"""The decision table: rows of every scope, the routing of air-flow and pressure faults, and the cap of confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.sources.scratch import written

#: Columns of the table, in order.
COLUMNS = {
    "proxy_id": "string", "sub_check_id": "string", "unit_scope": "string", "trip_id": "string", "segment_id": "string", "engine_start_episode_id": "string", "evidence_start_timestamp": "long",
    "evidence_end_timestamp": "long", "direction": "string", "decision_role": "string", "result_state": "string", "decision_reason": "string", "decision_margin": "double", "dtc_candidate_label": "string",
    "dtc_emitted": "boolean", "routing_attribution": "string", "routed_dtc": "string", "confidence": "string", "confidence_capped_low": "boolean", "evidence_count": "long", "opportunity_present": "boolean",
}
MAP_WITNESSES, AIR_CHECKS, DIRECT = ("5-S3", "5-S1"), ("2-S2", "5-S2"), "2-S3b"
ROUTES = {"abnormal": ("map_sensor", "P0106"), "normal": ("maf_sensor", "P0101"), "unknown": ("unisolated", "P006A"), "direct": ("direct", "P0102")}


def of_scope(rows: DataFrame, scope: str) -> DataFrame:
    """Decisions of one scope in the table's columns, before routing: nothing is emitted yet."""
    sub = F.col("sub_check_id")
    family = F.create_map(*[F.lit(x) for kv in k.PROXIES.items() for x in kv])
    made = {
        "proxy_id": F.element_at(family, F.substring(sub, 1, 1)), "unit_scope": F.lit(scope), "engine_start_episode_id": F.col("episode_id") if "episode_id" in rows.columns else F.lit(None), "evidence_start_timestamp": F.col("start_t"),
        "evidence_end_timestamp": F.col("end_t"), "dtc_candidate_label": F.col("dtc_candidate"), "dtc_emitted": F.lit(False), "routing_attribution": F.lit(None), "routed_dtc": F.lit(None),
        "confidence": F.when(F.col("decision_role") == "support", "low").when(sub == "3-S1b", "provisional").otherwise("high"), "confidence_capped_low": F.lit(False),
    }
    return rows.select(*[made.get(c, F.col(c)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def routed(decisions: DataFrame, capped: DataFrame) -> DataFrame:
    """``decisions`` with attribution, routed code, emission and the cap of confidence.

    A triggered air-flow check of a trip goes to the pressure sensor if any of the trip's witnesses triggers, to
    the air-flow sensor if all of them could be evaluated, and to neither otherwise. Its confidence is low in the
    trips ``capped`` (trip_id). 5-S2 is evidence and emits nothing; the direct check needs no witness; every other
    triggered verdict emits its own code. Witnesses take one row a trip.
    """
    told = lambda sub, *states: F.max(F.coalesce((F.col("sub_check_id") == sub) & F.col("result_state").isin(*states), F.lit(False)))
    abnormal, known = (reduce(how, [told(w, *states) for w in MAP_WITNESSES]) for how, states in ((lambda a, b: a | b, ("triggered",)), (lambda a, b: a & b, ("pass", "triggered"))))
    witness = decisions.groupBy("trip_id").agg(abnormal.alias("_abnormal"), known.alias("_known"))
    df = decisions.join(witness, "trip_id").join(capped.select("trip_id").distinct().withColumn("_cap", F.lit(True)), "trip_id", "left")
    fired, sub = F.col("result_state") == "triggered", F.col("sub_check_id")
    air, direct = fired & sub.isin(*AIR_CHECKS), fired & (sub == DIRECT)
    own = fired & (F.col("decision_role") == "verdict") & ~sub.isin(*AIR_CHECKS, DIRECT)
    pick = lambda i: F.when(direct, ROUTES["direct"][i]).when(air & F.col("_abnormal"), ROUTES["abnormal"][i]).when(air & F.col("_known"), ROUTES["normal"][i]).when(air, ROUTES["unknown"][i])
    low = air & F.coalesce("_cap", F.lit(False))
    changed = {
        "routing_attribution": pick(0), "routed_dtc": F.when(own, F.col("dtc_candidate_label")).otherwise(pick(1)), "dtc_emitted": direct | own | (air & (sub == "2-S2")),
        "confidence": F.when(low, "low").otherwise(F.col("confidence")), "confidence_capped_low": low,
    }
    return df.select(*[changed.get(c, F.col(c)).alias(c) for c in COLUMNS])


def decision_table(trip: list[DataFrame], starts: DataFrame, cold: DataFrame, capped: DataFrame) -> DataFrame:
    """All decisions: of trips, of engine-start episodes and of segments' first rows, routed. They are written before, since routing reads them twice."""
    parts = [*(of_scope(t, "trip") for t in trip), of_scope(starts, "engine_start_episode"), of_scope(cold, "segment_first_row")]
    return routed(written(reduce(DataFrame.unionByName, parts), "decisions"), capped)
