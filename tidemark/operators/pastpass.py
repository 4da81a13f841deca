"""Every past feature from one table of instants.

Velocity, amount statistics, habits, cold start and decay all read the same instants of the same entities.
They are made once; each family computes its features per instant; the families meet on
(entity, value, second) and come back to the transactions together. Each step is as safe for hot entities as the
single features are, of which this gives the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import basic as B
from tidemark.operators import history as H
from tidemark.operators import velocity as V
from tidemark.session import cut_lineage

CARD = "card1"
_PAST = ["past_n", "past_an", "past_mean", "past_m2", "past_hsum", "gap", "past_gap_n", "past_gap_sum", "past_gap_sq"]


def family_columns(families: list[str]) -> dict[str, list[str]]:
    """The feature names of each family, in the order in which they are made."""
    every = {
        "velocity": [f"{e}_velocity_{w}" for e in config.VELOCITY_ENTITIES for w in config.VELOCITY_WINDOWS],
        "stats": [f"{e}_amt_{s}_{w}" for e, stats in config.STATS_BY_ENTITY.items() for s in stats for w in config.STATS_WINDOWS],
        "behaviour": ["amt_zscore_vs_card1_history", "time_since_last_txn_zscore", "hour_deviation"],
        "cold_start": [f"is_coldstart_{CARD}"],
        "decay": [V.ewm_name(e, w, lam) for e in config.VELOCITY_ENTITIES for lam in config.EWM_LAMBDAS for w in ("v", "f")],
    }
    return {f: every[f] for f in families}


def past_features(df: DataFrame, families: list[str], decay_until: int | None = None) -> DataFrame:
    """One row per transaction with the columns of `families`; decay is made up to the second `decay_until` only."""
    timed = df if "hour_of_day" in df.columns else B.calendar_set(df)
    rows = H.entity_rows(timed, config.VELOCITY_ENTITIES, V.ID, V.TIME, [V.AMOUNT, V.LABEL, "hour_of_day"])
    inst = cut_lineage(H.instants(rows, amount=V.AMOUNT, hour="hour_of_day", label=V.LABEL), "instants")
    at = [*H.KEYS, "ts"]
    parts = []
    if "velocity" in families:
        parts.append(H.sliding_counts(inst, config.VELOCITY_WINDOWS))
    if "stats" in families:
        some = inst.where(F.col("entity").isin(list(config.STATS_BY_ENTITY)))
        parts.append(H.sliding(some, {}, config.STATS_WINDOWS).select(*at, *[f"{s}_{w}" for w in config.STATS_WINDOWS for s in config.SUPPORTED_STATS]))
    if {"behaviour", "cold_start"} & set(families):
        parts.append(H.running(inst.where(F.col("entity") == CARD), sums=["n", "hsum"], amount=True, gaps=True).select(*at, *_PAST))
    if "decay" in families:
        known = inst if decay_until is None else inst.where(F.col("ts") <= decay_until)
        decayed = H.decayed(known, config.EWM_LAMBDAS, {"v": "n", "f": "f"})
        parts.append(decayed.select(*at, *[c for c in decayed.columns if c.startswith(("v_", "f_"))]))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    found = united.groupBy(*at).agg(*[F.max(c).alias(c) for c in united.columns if c not in at])
    hit = rows.join(found, at)
    made = {}

    def of(entity: str, column):
        return F.max(F.when(F.col("entity") == entity, column))

    for name in families:
        if name == "velocity":
            made |= {f"{e}_velocity_{w}": F.coalesce(of(e, F.col(f"n_{w}")), F.lit(0)) for e in config.VELOCITY_ENTITIES for w in config.VELOCITY_WINDOWS}
        elif name == "stats":
            made |= {f"{e}_amt_{s}_{w}": of(e, F.col(f"{s}_{w}")) for e, stats in config.STATS_BY_ENTITY.items() for s in stats for w in config.STATS_WINDOWS}
        elif name == "behaviour":
            made |= {n: F.coalesce(of(CARD, c), F.lit(0.0)) for n, c in V.zscore_columns("hour_of_day").items()}
        elif name == "cold_start":
            made[f"is_coldstart_{CARD}"] = (F.coalesce(of(CARD, F.col("past_n")), F.lit(0)) < config.COLDSTART_MIN_HISTORY).cast("int")
        elif name == "decay":
            made |= {V.ewm_name(e, w, lam): F.coalesce(of(e, F.col(f"{w}_{H.lambda_name(lam).replace('.', '_')}")), F.lit(0.0))
                     for e in config.VELOCITY_ENTITIES for lam in config.EWM_LAMBDAS for w in ("v", "f")}
    # Transactions without any entity value appear as a row that no feature matches.
    every = hit.drop("value", "ts").unionByName(df.select(F.col(V.ID).alias("id")), allowMissingColumns=True)
    return every.groupBy("id").agg(*[c.alias(n) for n, c in made.items()]).withColumnRenamed("id", V.ID)
