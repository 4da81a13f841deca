"""Strictly-past features per entity, safe for entities that hold a large share of all rows.

No step sorts or buffers all rows of one entity:

1. Rows are reduced to *instants*, one per (entity value, second), by a partial aggregation. Rows tied
   on a second never see each other, so they share every feature and nothing is lost.
2. Instants are cut into time blocks; a task sees one (entity value, block) at a time, so its size is
   bounded by the number of seconds in a block, whatever the number of rows.
3. Sliding windows use blocks as long as the window: a window then covers the tail of one block and the
   head of the next, so two cumulative aggregates per instant give counts, moments and maxima in linear
   time without subtracting running totals.
   Counts are whole numbers, so they may be subtracted: one block length serves all windows there.
4. Unbounded histories use one-day blocks: a small per-block table is accumulated per entity value and
   joined back as the state at the start of the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
KEYS = ["entity", "value"]
EARLIER_BLOCKS = Window.unboundedPreceding


def lambda_name(lam: float) -> str:
    return f"{lam:g}"


def entity_rows(df: DataFrame, entities: list[str], id_col: str, time_col: str, payload: list[str]) -> DataFrame:
    """One row per (transaction, entity) with a non-null entity value, as strings."""
    pairs = F.array(*[
        F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("value")) for e in entities
    ])
    return (
        df.select(F.col(id_col).alias("id"), F.col(time_col).cast("long").alias("ts"), *payload, F.explode(pairs).alias("p"))
        .select("id", "ts", *payload, "p.entity", "p.value")
        .where(F.col("value").isNotNull())
    )


def instants(rows: DataFrame, keys: list[str] = KEYS, amount: str | None = None, hour: str | None = None,
             label: str | None = None) -> DataFrame:
    """Rows reduced to one per (keys, second)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if amount:
        a = F.col(amount).cast("double")
        aggs += [
            F.count(a).alias("an"),
            F.avg(a).alias("mean"),
            F.sum(a).alias("asum"),
            (F.var_pop(a) * F.count(a)).alias("m2"),
            F.min(a).alias("lo"),
            F.max(a).alias("hi"),
        ]
    if hour:
        aggs.append(F.sum(F.col(hour).cast("double")).alias("hsum"))
    if label:
        aggs.append(F.sum(F.coalesce(F.col(label).cast("double"), F.lit(0.0))).alias("f"))
    return rows.groupBy(*keys, "ts").agg(*aggs)


def _half_moments(n: Column, center: Column, s1: Column, s2: Column, lo: Column, hi: Column) -> Column:
    """(count, mean, squared deviations, max) from sums taken around `center`; exact for equal values."""
    flat = lo == hi
    mean = F.when(flat, lo).otherwise(center + s1 / n)
    m2 = F.when(flat, F.lit(0.0)).otherwise(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)))
    return F.when(n > 0, F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"), hi.alias("hi")))


def _merge(a: Column, b: Column, part: str) -> Column:
    """Combine two moment structs, either of which may be null."""
    na, nb = a["n"], b["n"]
    both = a.isNotNull() & b.isNotNull()
    n = F.coalesce(na, F.lit(0)) + F.coalesce(nb, F.lit(0))
    if part == "n":
        return n
    if part == "hi":
        return F.greatest(a["hi"], b["hi"])
    if part == "mean":
        merged = a["mean"] + (b["mean"] - a["mean"]) * nb / (na + nb)
    else:
        gap = b["mean"] - a["mean"]
        merged = a["m2"] + b["m2"] + gap * gap * na * nb / (na + nb)
    return F.when(both, merged).otherwise(F.coalesce(a[part], b[part]))


def sliding(inst: DataFrame, counts: dict[str, int], moments: dict[str, int] | None = None,
            keys: list[str] = KEYS) -> DataFrame:
    """Counts and amount statistics over the `w` seconds before each instant.

    `counts` and `moments` map a label to a window length. The window is [t - w, t - 1]. Adds
    `n_<label>` and `mean_/std_/max_<label>`; the result has one row per (keys, ts).
    """
    if not moments:
        return sliding_counts(inst, counts, keys)
    windows = {**counts, **moments}
    # Per window three marks: the instant in its block in time order (head), the instant again in
    # reverse order, and a question at t - w that reads the reversed block up to there (tail). Both
    # directions then need the same frame: everything before the mark.
    marks = []
    for label, length in windows.items():
        blk = F.floor(F.col("ts") / length)
        for back, question in ((0, 0), (1, 0), (1, 1)):
            at = F.col("ts") - length if question else F.col("ts")
            marks.append(F.struct(
                F.lit(label).alias("w"), F.lit(back).alias("back"), F.lit(question).alias("question"),
                (blk - question).alias("blk"), (-at if back else at).alias("at")))
    measures = ["n", "an", "mean", "m2", "lo", "hi"]
    marked = inst.select(*keys, "ts", *measures, F.explode(F.array(*marks)).alias("mk"))
    marked = marked.select(*keys, "ts", "mk.*", *[F.when(F.col("mk.question") == 0, F.col(m)).alias(m) for m in measures])
    block = [*keys, "w", "back", "blk"]
    before = Window.partitionBy(*block).orderBy("at", "question").rowsBetween(EARLIER_BLOCKS, -1)
    whole = Window.partitionBy(*block)
    marked = marked.withColumn("center", F.sum(F.col("an") * F.col("mean")).over(whole) / F.nullif(F.sum("an").over(whole), F.lit(0)))
    off = F.col("mean") - F.col("center")
    marked = marked.withColumn("d1", F.col("an") * off).withColumn("d2", F.col("m2") + F.col("an") * off * off)
    parts = marked.select(
        *keys, "ts", "w", "back", "question", F.sum("n").over(before).alias("p_n"), F.sum("an").over(before).alias("p_an"), F.col("center"),
        F.sum("d1").over(before).alias("p_s1"), F.sum("d2").over(before).alias("p_s2"), F.min("lo").over(before).alias("p_lo"), F.max("hi").over(before).alias("p_hi"))
    parts = parts.where(F.col("back") == F.col("question")).withColumn(
        "half", _half_moments(*[F.col(c) for c in ["p_an", "center", "p_s1", "p_s2", "p_lo", "p_hi"]]))
    aggs = [
        F.coalesce(F.sum(F.when(F.col("w") == label, F.col("p_n"))), F.lit(0)).alias(f"n_{label}") for label in windows
    ]
    for label in moments:
        for side in (0, 1):
            hit = (F.col("w") == label) & (F.col("question") == side)
            aggs.append(F.max(F.when(hit, F.col("half"))).alias(f"h{side}_{label}"))
    out = parts.groupBy(*keys, "ts").agg(*aggs)
    for label in moments:
        a, b = F.col(f"h0_{label}"), F.col(f"h1_{label}")
        n = _merge(a, b, "n")
        out = out.withColumns({
            f"mean_{label}": _merge(a, b, "mean"),
            f"std_{label}": F.when(n >= 2, F.sqrt(_merge(a, b, "m2") / (n - 1))),
            f"max_{label}": _merge(a, b, "hi"),
        }).drop(f"h0_{label}", f"h1_{label}")
    return out


def sliding_counts(inst: DataFrame, windows: dict[str, int], keys: list[str] = KEYS) -> DataFrame:
    """`n_<label>`: rows in the `w` seconds before each instant, for several windows in one pass.

    Blocks are as long as the longest window. Each instant asks for the number of rows before t and
    before each t - w; both lie in its own block or the one before, whose total is known there.
    """
    block = max(windows.values())
    asks = [F.struct(F.lit(None).cast("string").alias("w"), F.col("ts").alias("at"))]
    asks += [F.struct(F.lit(label).alias("w"), (F.col("ts") - length).alias("at")) for label, length in windows.items()]
    marks = inst.select(*keys, "ts", "n", F.explode(F.array(*asks)).alias("a")).select(*keys, "ts", "a.*", F.when(F.col("a.w").isNull(), F.col("n")).alias("n"))
    marks = marks.withColumn("blk", F.floor(F.col("at") / block))
    group = [*keys, "blk"]
    # Instants are unique per time and questions count nothing, so the order of equal times is settled
    # by putting questions first: rows at t - w itself still belong to the window.
    order = Window.partitionBy(*group).orderBy("at", F.col("w").isNull()).rowsBetween(EARLIER_BLOCKS, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    counted = marks.select(*keys, "ts", "w", "blk", before.alias("before"), F.coalesce(F.sum("n").over(Window.partitionBy(*group)), F.lit(0)).alias("total"))
    own = F.floor(F.col("ts") / block)
    part = F.when(F.col("w").isNull(), F.col("before")).when(F.col("blk") == own, -F.col("before")).otherwise(F.col("total") - F.col("before"))
    aggs = [F.sum(F.when(F.col("w").isNull() | (F.col("w") == label), part)).alias(f"n_{label}") for label in windows]
    return counted.groupBy(*keys, "ts").agg(*aggs)


def running(inst: DataFrame, keys: list[str] = KEYS, sums: list[str] | None = None, maxs: list[str] | None = None,
            mins: list[str] | None = None, amount: bool = False, gaps: bool = False,
            inclusive: bool = False, block: int = DAY) -> DataFrame:
    """State over all instants before each one (`inclusive`: up to and including it).

    Adds `past_<c>` for each listed column; with `amount` the moments `past_an/mean/m2`, whose mean is the
    amounts added up in order of time over their count, as plain SQL has it: no rounding of centres and merges
    decides whether an amount equals it; with `gaps`
    the time since the previous instant and the number, sum and sum of squares of past gaps between
    rows (`gap`, `past_gap_n/sum/sq`); needs `n`.
    """
    sums, maxs, mins = sums or [], maxs or [], mins or []
    last = 0 if inclusive else -1
    group = [*keys, "blk"]
    whole = Window.partitionBy(*group)
    ordered = Window.partitionBy(*group).orderBy("ts")
    inside = ordered.rowsBetween(EARLIER_BLOCKS, last)

    x = inst.withColumn("blk", F.floor(F.col("ts") / block))
    totals = [F.sum(c).alias(f"b_{c}") for c in sums] + [F.max(c).alias(f"b_{c}") for c in maxs] + [F.min(c).alias(f"b_{c}") for c in mins]
    if amount:
        x = x.withColumn("center", F.sum(F.col("an") * F.col("mean")).over(whole) / F.nullif(F.sum("an").over(whole), F.lit(0)))
        off = F.col("mean") - F.col("center")
        x = x.withColumn("d1", F.col("an") * off).withColumn("d2", F.col("m2") + F.col("an") * off * off)
        totals += [
            F.sum("an").alias("b_an"), F.max("center").alias("b_center"), F.sum("d1").alias("b_d1"),
            F.sum("d2").alias("b_d2"), F.min("lo").alias("b_lo"), F.max("hi").alias("b_hi"), F.sum("asum").alias("b_asum"),
        ]
    if gaps:
        x = x.withColumn("prev_in", F.lag("ts").over(ordered))
        x = x.withColumn("gap_sq", (F.col("ts") - F.col("prev_in")) * (F.col("ts") - F.col("prev_in")))
        totals += [
            F.sum("n").alias("b_rows"), F.min("ts").alias("b_first"), F.max("ts").alias("b_last"), F.sum("gap_sq").alias("b_gap_sq"),
        ]

    earlier = Window.partitionBy(*keys).orderBy("blk").rowsBetween(EARLIER_BLOCKS, -1)
    entity = Window.partitionBy(*keys)
    blocks = x.groupBy(*group).agg(*totals)
    if amount:
        blocks = blocks.withColumn("b_half", _half_moments(*[F.col(c) for c in ["b_an", "b_center", "b_d1", "b_d2", "b_lo", "b_hi"]]))
        bn, bmean = F.col("b_half.n"), F.col("b_half.mean")
        blocks = blocks.withColumn("e_center", F.sum(bn * bmean).over(entity) / F.sum(bn).over(entity))
        boff = bmean - F.col("e_center")
        blocks = blocks.withColumn("e1", bn * boff).withColumn("e2", F.col("b_half.m2") + bn * boff * boff)
    if gaps:
        blocks = blocks.withColumn("cross", F.col("b_first") - F.lag("b_last").over(Window.partitionBy(*keys).orderBy("blk")))
        blocks = blocks.withColumn("cross_sq", F.col("cross") * F.col("cross"))
    state = [F.sum(f"b_{c}").over(earlier).alias(f"c_{c}") for c in sums]
    state += [F.max(f"b_{c}").over(earlier).alias(f"c_{c}") for c in maxs]
    state += [F.min(f"b_{c}").over(earlier).alias(f"c_{c}") for c in mins]
    if amount:
        state.append(_half_moments(
            F.sum("b_half.n").over(earlier), F.col("e_center"), F.sum("e1").over(earlier), F.sum("e2").over(earlier),
            F.min("b_lo").over(earlier), F.max("b_hi").over(earlier)).alias("c_half"))
        state += [F.sum("b_asum").over(earlier).alias("c_asum"), F.min("b_lo").over(earlier).alias("c_amt_lo"), F.max("b_hi").over(earlier).alias("c_amt_hi")]
    if gaps:
        state += [
            F.sum("b_rows").over(earlier).alias("c_rows"), F.min("b_first").over(earlier).alias("c_first"),
            F.max("b_last").over(earlier).alias("c_last"), F.col("cross_sq"),
            F.sum(F.coalesce("b_gap_sq", F.lit(0)) + F.coalesce("cross_sq", F.lit(0))).over(earlier).alias("c_gap_sq"),
        ]
    carry = blocks.select(*group, *state)

    # Every block has its carry. A left join keeps Spark from adding null filters below one side only,
    # so that both sides share one shuffle of the instants.
    y = x.join(carry, group, "left")
    add = {}
    for c in sums:
        add[f"past_{c}"] = F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(F.col(f"c_{c}"), F.lit(0))
    for c in maxs:
        add[f"past_{c}"] = F.greatest(F.max(c).over(inside), F.col(f"c_{c}"))
    for c in mins:
        add[f"past_{c}"] = F.least(F.min(c).over(inside), F.col(f"c_{c}"))
    if amount:
        add["i_half"] = _half_moments(
            F.sum("an").over(inside), F.col("center"), F.sum("d1").over(inside), F.sum("d2").over(inside),
            F.min("lo").over(inside), F.max("hi").over(inside))
        add["amt_sum"] = F.coalesce("c_asum", F.lit(0.0)) + F.coalesce(F.sum("asum").over(inside), F.lit(0.0))
        add["amt_lo"] = F.least(F.min("lo").over(inside), F.col("c_amt_lo"))
        add["amt_hi"] = F.greatest(F.max("hi").over(inside), F.col("c_amt_hi"))
    if gaps:
        add["i_rows"] = F.sum("n").over(inside)
        add["i_gap_sq"] = F.coalesce(F.sum("gap_sq").over(inside), F.lit(0))
    y = y.withColumns(add)
    if amount:
        a, b = F.col("c_half"), F.col("i_half")
        n = _merge(a, b, "n")
        mean = F.when(F.col("amt_lo") == F.col("amt_hi"), F.col("amt_lo")).otherwise(F.col("amt_sum") / F.nullif(n, F.lit(0)))
        y = y.withColumns({"past_an": n, "past_mean": mean, "past_m2": _merge(a, b, "m2")})
    if gaps:
        prev = F.coalesce("prev_in", "c_last")
        first = F.coalesce("c_first", F.min("ts").over(inside))
        rows = F.coalesce("i_rows", F.lit(0)) + F.coalesce("c_rows", F.lit(0))
        opened = F.when(F.col("i_rows") > 0, F.coalesce("cross_sq", F.lit(0))).otherwise(F.lit(0))
        y = y.withColumns({
            "gap": F.col("ts") - prev,
            "past_gap_n": F.greatest(rows - 1, F.lit(0)),
            "past_gap_sum": F.coalesce(prev - first, F.lit(0)),
            "past_gap_sq": F.coalesce("c_gap_sq", F.lit(0)) + opened + F.col("i_gap_sq"),
        })
    new = [c for c in y.columns if c.startswith("past_") or c == "gap"]
    return y.select(*inst.columns, *new)


def _super_days(lam: float) -> int:
    """Days per super block, so that rates within one never exceed exp(200)."""
    return max(1, int(200 // (24 * lam)))


def _day_totals(inst: DataFrame, lambdas: list[float], weights: dict[str, str], keys: list[str]) -> DataFrame:
    """Per (keys, day): every event's weight decayed to the end of its day."""
    x = inst.withColumn("blk", F.floor(F.col("ts") / DAY))
    to_end = (F.col("ts") - (F.col("blk") + 1) * DAY) / 3600.0
    aggs = [F.max("ts").alias("last_t")]
    for lam in lambdas:
        for w, c in weights.items():
            aggs.append(F.sum(F.col(c) * F.exp(lam * to_end)).alias(f"d_{w}_{lambda_name(lam).replace('.', '_')}"))
    return x.groupBy(*keys, "blk").agg(*aggs)


def decayed(inst: DataFrame, lambdas: list[float], weights: dict[str, str], keys: list[str] = KEYS) -> DataFrame:
    """Exponentially decayed sums of past weights before each instant.

    `weights` maps an output stem to a column of `inst`. Adds `<stem>_<lambda>` columns. Sums are
    rebased to the start of a day, days to the start of a super block of at most 200/lambda hours, so
    no exponent leaves the double range. The past before a super block is that of the latest earlier
    one with any weight, which has taken in the one with weight before it; what lies further back
    adds less than a double can hold beside it, since whole super blocks decay by more than exp(-100).
    However old, a past with weight stays positive as long as doubles reach.
    """
    x = inst.withColumn("blk", F.floor(F.col("ts") / DAY))
    hours = (F.col("ts") - F.col("blk") * DAY) / 3600.0
    totals = _day_totals(inst, lambdas, weights, keys)
    carry = totals
    for lam in lambdas:
        per_day, size = 24 * lam, _super_days(lam)
        tag = lambda_name(lam).replace(".", "_")
        carry = carry.withColumn("sup", F.floor(F.col("blk") / size))
        day_in = F.col("blk") - F.col("sup") * size
        same = Window.partitionBy(*keys, "sup")
        earlier = Window.partitionBy(*keys).orderBy("sup").rangeBetween(Window.unboundedPreceding, -1)
        rebased = {w: F.col(f"d_{w}_{tag}") * F.exp(per_day * (day_in + 1)) for w in weights}

        def latest(column: str):
            """(sup, v) of the latest earlier super block where the column is positive."""
            return F.last(F.when(F.col(column) > 0, F.struct("sup", F.col(column).alias("v"))), ignorenulls=True).over(earlier)

        def decayed_to(past: str, hours_in):
            gone = per_day * (hours_in + (F.col("sup") - F.col(f"{past}.sup")) * size)
            return F.coalesce(F.col(f"{past}.v") * F.exp(-gone), F.lit(0.0))

        carry = carry.withColumns({f"s_{w}": F.sum(rebased[w]).over(same) for w in weights} | {f"i_{w}": F.coalesce(F.sum(rebased[w]).over(same.orderBy("blk").rowsBetween(EARLIER_BLOCKS, -1)), F.lit(0.0)) for w in weights})
        carry = carry.withColumns({f"p_{w}": latest(f"s_{w}") for w in weights})
        carry = carry.withColumns({f"y_{w}": F.col(f"s_{w}") + decayed_to(f"p_{w}", F.lit(0)) for w in weights})
        carry = carry.withColumns({f"q_{w}": latest(f"y_{w}") for w in weights})
        carry = carry.withColumns({f"c_{w}_{tag}": F.col(f"i_{w}") * F.exp(-per_day * day_in) + decayed_to(f"q_{w}", day_in) for w in weights})
        carry = carry.drop("sup", *[f"{k}_{w}" for k in "sipyq" for w in weights])
    carry = carry.select(*keys, "blk", *[f"c_{w}_{lambda_name(lam).replace('.', '_')}" for lam in lambdas for w in weights])
    inside = Window.partitionBy(*keys, "blk").orderBy("ts").rowsBetween(EARLIER_BLOCKS, -1)
    y = x.join(carry, [*keys, "blk"], "left")  # left: see `running`
    add = {}
    for lam in lambdas:
        tag = lambda_name(lam).replace(".", "_")
        for w, c in weights.items():
            head = F.coalesce(F.sum(F.col(c) * F.exp(lam * hours)).over(inside), F.lit(0.0))
            add[f"{w}_{tag}"] = F.exp(-lam * hours) * (F.col(f"c_{w}_{tag}") + head)
    return y.withColumns(add).select(*inst.columns, *add)


def end_state(inst: DataFrame, lambdas: list[float], weights: dict[str, str], keys: list[str] = KEYS) -> DataFrame:
    """Decayed sums as of each key's last event: one row per (keys, lambda)."""
    totals = _day_totals(inst, lambdas, weights, keys)
    entity = Window.partitionBy(*keys)
    totals = totals.withColumn("end_t", F.max("last_t").over(entity))
    since = (F.col("end_t") - (F.col("blk") + 1) * DAY) / 3600.0
    aggs = [F.max("end_t").alias("last_t")]
    for lam in lambdas:
        tag = lambda_name(lam).replace(".", "_")
        for w in weights:
            aggs.append(F.sum(F.col(f"d_{w}_{tag}") * F.exp(-lam * since)).alias(f"{w}_{tag}"))
    wide = totals.groupBy(*keys).agg(*aggs)
    states = F.array(*[
        F.struct(F.lit(lam).alias("lambda"), *[F.col(f"{w}_{lambda_name(lam).replace('.', '_')}").alias(w) for w in weights])
        for lam in lambdas
    ])
    return wide.select(*keys, "last_t", F.explode(states).alias("s")).select(*keys, "last_t", "s.*")


def spread(df: DataFrame, rows: DataFrame, features: DataFrame, id_col: str, columns: dict[str, tuple[str, str]],
           keys: list[str] = KEYS) -> DataFrame:
    """Bring instant features back to transactions, one output column per (entity, feature).

    `columns` maps an output name to (entity, feature). Every transaction is kept; those without the
    entity get NULL. The join key carries the second, so a hot entity spreads over many tasks.
    """
    used = sorted({f for _, f in columns.values()})
    joined = rows.select("id", "entity", "value", "ts").join(features.select(*keys, "ts", *used), [*keys, "ts"])
    blank = df.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("entity"),
                      *[F.lit(None).cast(features.schema[f].dataType).alias(f) for f in used])
    both = joined.select("id", "entity", *used).unionByName(blank)
    return both.groupBy("id").agg(*[
        F.max(F.when(F.col("entity") == e, F.col(f))).alias(name) for name, (e, f) in columns.items()
    ]).withColumnRenamed("id", id_col)
