"""Point-in-time features per transaction: velocity, statistics, behaviour, cold start, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import history as H

ID, TIME, AMOUNT, LABEL = "TransactionID", "TransactionDT", "TransactionAmt", "isFraud"


def require_columns(df: DataFrame, needed: list[str]) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise KeyError(f"missing required columns: {missing}")


def velocity(df: DataFrame, entities: list[str] | None = None, windows: dict[str, int] | None = None) -> DataFrame:
    """`{entity}_velocity_{window}`: past rows of the entity in the window; 0 for a NULL entity."""
    entities = entities or config.VELOCITY_ENTITIES
    windows = windows or config.VELOCITY_WINDOWS
    require_columns(df, [ID, TIME, *entities])
    rows = H.entity_rows(df, entities, ID, TIME, [])
    feats = H.sliding(H.instants(rows), windows)
    cols = {f"{e}_velocity_{w}": (e, f"n_{w}") for e in entities for w in windows}
    return H.spread(df, rows, feats, ID, cols).fillna(0)


def amount_stats(df: DataFrame, by_entity: dict[str, list[str]] | None = None, windows: dict[str, int] | None = None) -> DataFrame:
    """`{entity}_amt_{stat}_{window}` over past non-null amounts; NULL where there are none."""
    by_entity = by_entity or config.STATS_BY_ENTITY
    windows = windows or config.STATS_WINDOWS
    unknown = sorted({s for stats in by_entity.values() for s in stats} - set(config.SUPPORTED_STATS))
    if unknown:
        raise ValueError(f"unsupported statistics: {unknown}")
    require_columns(df, [ID, TIME, AMOUNT, *by_entity])
    rows = H.entity_rows(df, list(by_entity), ID, TIME, [AMOUNT])
    feats = H.sliding(H.instants(rows, amount=AMOUNT), {}, windows)
    cols = {f"{e}_amt_{s}_{w}": (e, f"{s}_{w}") for e, stats in by_entity.items() for s in stats for w in windows}
    return H.spread(df, rows, feats, ID, cols)


def _card_rows(df: DataFrame, entity: str, *columns: str) -> DataFrame:
    return df.where(F.col(entity).isNotNull()).select(
        F.col(ID).alias("id"), F.col(TIME).cast("long").alias("ts"), F.col(entity).alias("card"), *columns)


def _attach(df: DataFrame, rows: DataFrame, feats: DataFrame, columns: dict[str, object]) -> DataFrame:
    """Evaluate `columns` on rows joined to their instant's features; 0 where nothing applies."""
    hit = rows.join(feats, ["card", "ts"]).select("id", *[c.alias(n) for n, c in columns.items()])
    out = df.select(ID).join(hit.withColumnRenamed("id", ID), ID, "left")
    return out.fillna(0, list(columns))


def zscores(df: DataFrame, entity: str = "card1", hour: str = "hour_of_day") -> DataFrame:
    """Amount and inter-arrival z-scores and hour deviation against the entity's whole past."""
    require_columns(df, [ID, TIME, AMOUNT, entity, hour])
    rows = _card_rows(df, entity, AMOUNT, hour)
    inst = H.instants(rows, ["card"], amount=AMOUNT, hour=hour)
    past = H.running(inst, ["card"], sums=["hsum"], amount=True, gaps=True)
    past = past.select("card", "ts", "past_an", "past_mean", "past_m2", "past_hsum", "gap", "past_gap_n", "past_gap_sum", "past_gap_sq")
    return _attach(df, rows, past, zscore_columns(hour))


def zscore_columns(hour: str) -> dict[str, Column]:
    """The scores of a row with its amount and hour beside the past of its card, as `running` gives it."""
    eps = config.ZSCORE_EPSILON
    n, gn = F.col("past_an"), F.col("past_gap_n").cast("double")
    gate = n > 0
    std = F.sqrt(F.col("past_m2") / F.nullif(n - 1, F.lit(0)))
    gap_mean = F.col("past_gap_sum") / F.nullif(gn, F.lit(0.0))
    # The gaps are whole seconds, so n * sum of squares - square of sum is exact before the division.
    gap_var = (gn * F.col("past_gap_sq") - F.col("past_gap_sum").cast("double") * F.col("past_gap_sum")) / F.nullif(gn * (gn - 1), F.lit(0.0))
    gap_std = F.sqrt(F.greatest(gap_var, F.lit(0.0)))
    return {
        "amt_zscore_vs_card1_history": F.when(gate & (n >= 2), (F.col(AMOUNT) - F.col("past_mean")) / (std + eps)),
        "time_since_last_txn_zscore": F.when(gate & (gn >= 2), (F.col("gap") - gap_mean) / (gap_std + eps)),
        "hour_deviation": F.when(gate, F.abs(F.col(hour) - F.col("past_hsum") / F.nullif(n, F.lit(0)))),
    }


def address_change(df: DataFrame, entity: str = "card1", address: str = "addr1") -> DataFrame:
    """1 where the address differs from the running mode of past addresses (ties: first seen)."""
    require_columns(df, [ID, TIME, AMOUNT, entity, address])
    rows = _card_rows(df, entity, AMOUNT, address)
    seen = rows.where(F.col(address).isNotNull()).groupBy("card", address, "ts").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    # How often each address had been used up to and including each of its instants.
    used = H.running(seen, ["card", address], sums=["n"], mins=["first"], inclusive=True)
    rank = F.struct(F.col("past_n").alias("uses"), (-F.col("past_first.ts")).alias("first_ts"),
                    (-F.col("past_first.id")).alias("first_id"), F.col(address).alias("address"))
    # The mode before t is the best of these over all earlier instants: an address's count only grows.
    lead = used.groupBy("card", "ts").agg(F.max(rank).alias("lead"))
    amounts = rows.groupBy("card", "ts").agg(F.count(AMOUNT).alias("an"))
    inst = amounts.join(lead, ["card", "ts"], "left")
    past = H.running(inst, ["card"], sums=["an"], maxs=["lead"]).select("card", "ts", "past_an", "past_lead")
    changed = (F.col("past_an") > 0) & (F.col(address) != F.col("past_lead.address"))
    return _attach(df, rows, past, {"addr_change_flag": F.coalesce(changed, F.lit(False)).cast("int")})


def device_change(df: DataFrame, entity: str = "card1", device: str = "DeviceInfo") -> DataFrame:
    """1 where the device is new to an entity that has used other devices before.

    Needs first appearances only, so plain aggregations replace any per-entity set. A new device shows at its
    first second alone, so rows meet those seconds by entity, device and time, which spreads a hot entity.
    """
    require_columns(df, [ID, TIME, AMOUNT, entity, device])
    rows = _card_rows(df, entity, AMOUNT, device)
    first_use = rows.where(F.col(device).isNotNull()).groupBy("card", device).agg(F.min("ts").alias("device_since"))
    known = rows.groupBy("card").agg(
        F.min(F.when(F.col(device).isNotNull(), F.col("ts"))).alias("any_device_since"),
        F.min(F.when(F.col(AMOUNT).isNotNull(), F.col("ts"))).alias("amount_since"))
    changes = first_use.join(known, "card").where((F.col("any_device_since") < F.col("device_since")) & (F.col("amount_since") < F.col("device_since")))
    flagged = rows.join(changes.select("card", device, F.col("device_since").alias("ts")), ["card", device, "ts"]).select(F.col("id").alias(ID), F.lit(1).alias("device_change_flag"))
    return df.select(ID).join(flagged, ID, "left").fillna(0, ["device_change_flag"])


def cold_start(df: DataFrame, entities: list[str] | None = None, min_history: int = config.COLDSTART_MIN_HISTORY) -> DataFrame:
    """`is_coldstart_{entity}`: 1 with fewer than `min_history` past rows or a NULL entity."""
    entities = entities or ["card1"]
    require_columns(df, [ID, TIME, *entities])
    rows = H.entity_rows(df, entities, ID, TIME, [])
    past = H.running(H.instants(rows), sums=["n"])
    wide = H.spread(df, rows, past, ID, {f"is_coldstart_{e}": (e, "past_n") for e in entities})
    return wide.select(ID, *[
        (F.coalesce(F.col(f"is_coldstart_{e}"), F.lit(0)) < min_history).cast("int").alias(f"is_coldstart_{e}") for e in entities])


def checked_lambdas(lambdas: list[float]) -> list[float]:
    if len(set(lambdas)) != len(lambdas):
        raise ValueError(f"duplicate decay rates: {lambdas}")
    return lambdas


def ewm_name(entity: str, weight: str, lam: float) -> str:
    return f"{entity}_{'fraud_v' if weight == 'f' else 'v'}_ewm_lambda_{H.lambda_name(lam)}"


def ewm(df: DataFrame, entities: list[str] | None = None, lambdas: list[float] | None = None, fraud_weighted: bool = True) -> DataFrame:
    """Decayed past event counts and decayed past labels per entity and rate; 0 without history."""
    entities = entities or config.VELOCITY_ENTITIES
    lambdas = checked_lambdas(lambdas or config.EWM_LAMBDAS)
    require_columns(df, [ID, TIME, *entities, *([LABEL] if fraud_weighted else [])])
    rows = H.entity_rows(df, entities, ID, TIME, [LABEL] if fraud_weighted else [])
    inst = H.instants(rows, label=LABEL if fraud_weighted else None)
    weights = {"v": "n", "f": "f"} if fraud_weighted else {"v": "n"}
    feats = H.decayed(inst, lambdas, weights)
    cols = {
        ewm_name(e, w, lam): (e, f"{w}_{H.lambda_name(lam).replace('.', '_')}")
        for e in entities for lam in lambdas for w in weights
    }
    return H.spread(df, rows, feats, ID, cols).fillna(0.0)


def ewm_end_state(df: DataFrame, entities: list[str] | None = None, lambdas: list[float] | None = None) -> DataFrame:
    """The state each (entity, rate) has after its last event: `last_t`, `v`, `fraud_v`."""
    entities = entities or config.VELOCITY_ENTITIES
    lambdas = checked_lambdas(lambdas or config.EWM_LAMBDAS)
    rows = H.entity_rows(df, entities, ID, TIME, [LABEL])
    state = H.end_state(H.instants(rows, label=LABEL), lambdas, {"v": "n", "f": "f"})
    return state.withColumnRenamed("f", "fraud_v")


def ewm_held_out(df: DataFrame, state: DataFrame, entities: list[str] | None = None, lambdas: list[float] | None = None) -> DataFrame:
    """Held-out rows read the frozen end state decayed to their time; unseen values give 0.

    `backward_rows` counts per row how many states lie after it: the caller must reject a non-zero sum.
    """
    entities = entities or config.VELOCITY_ENTITIES
    lambdas = lambdas or config.EWM_LAMBDAS
    rows = H.entity_rows(df, entities, ID, TIME, [])
    hit = rows.join(state, ["entity", "value"])
    decay = F.exp(-F.col("lambda") * (F.col("ts") - F.col("last_t")) / 3600.0)
    hit = hit.select("id", "entity", "lambda", (F.col("v") * decay).alias("v"), (F.col("fraud_v") * decay).alias("f"),
                     (F.col("ts") < F.col("last_t")).cast("int").alias("back"))
    blank = df.select(F.col(ID).alias("id"))
    both = hit.unionByName(blank, allowMissingColumns=True)
    aggs = []
    for e in entities:
        for lam in lambdas:
            here = (F.col("entity") == e) & (F.col("lambda") == lam)
            for w in ("v", "f"):
                aggs.append(F.coalesce(F.max(F.when(here, F.col(w))), F.lit(0.0)).alias(ewm_name(e, w, lam)))
    return both.groupBy("id").agg(*aggs, F.coalesce(F.sum("back"), F.lit(0)).alias("backward_rows")).withColumnRenamed("id", ID)


def strict_past(df: DataFrame, entity: str, aggregates: dict[str, Column], seconds: int | None = None) -> DataFrame:
    """Any aggregate of the caller's over an entity's rows strictly before each row, at most `seconds` back.

    `aggregates` maps names to aggregate columns. An aggregate that can't be merged from parts needs an entity's
    rows in order in one task; for entities that own a large share of the rows use `velocity`, `amount_stats` or
    `ewm`, whose aggregates can. Rows without the entity have no past and get what the aggregate gives for no rows.
    """
    require_columns(df, [ID, TIME, entity])
    past = Window.partitionBy(entity).orderBy(F.col(TIME).cast("long")).rangeBetween(Window.unboundedPreceding if seconds is None else -seconds, -1)
    known = df.where(F.col(entity).isNotNull()).select(ID, *[a.over(past).alias(n) for n, a in aggregates.items()])
    empty = df.limit(0).agg(*[a.alias(n) for n, a in aggregates.items()])
    alone = df.where(F.col(entity).isNull()).select(ID).crossJoin(F.broadcast(empty))  # one row
    return known.unionByName(alone)
