"""The graph of transactions and the entity values they share: counts, components, rank, clustering.

Edges are never held by a node: every step is a join or an aggregation over the edge table, hubs are
reduced by partial aggregation, and joins towards hubs are split by adaptive execution.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.numeric import ratio
from tidemark.functions.ranks import dense_index
from tidemark.operators.clean import hash_fold
from tidemark.session import cut_lineage

ID, LABEL = "TransactionID", "isFraud"
ENTITIES = config.VELOCITY_ENTITIES
# Rank iteration, and the relative change of an entity's rank at which it has settled.
DAMPING, MAX_ITERATIONS, TOLERANCE = 0.85, 20, 1e-3
SETTLED, SETTLED_ROUNDS = 1e-6, 60
_SEP = "\u0001"


def edges(df: DataFrame, entities: list[str] = ENTITIES, keep: list[str] | None = None) -> DataFrame:
    """Distinct (txn, subtype, value, *keep) pairs; a NULL entity makes no edge."""
    keep = keep or []
    pairs = F.array(*[F.struct(F.lit(e).alias("subtype"), F.col(e).cast("string").alias("value")) for e in entities])
    long = df.select(F.col(ID).alias("txn"), *keep, F.explode(pairs).alias("p")).select("txn", *keep, "p.*").where(F.col("value").isNotNull())
    return long.distinct()


def graph_stats(df: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """Nodes, edges, transactions and entity values by subtype."""
    e = edges(df, entities)
    per_value = e.groupBy("subtype", "value").agg(F.count(F.lit(1)).alias("n"))
    by_type = per_value.groupBy("subtype").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("edges"))
    wide = by_type.agg(
        F.coalesce(F.sum("edges"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum("entities"), F.lit(0)).alias("n_entities"),
        *[F.coalesce(F.sum(F.when(F.col("subtype") == s, F.col("entities"))), F.lit(0)).alias(f"n_{s}") for s in entities])
    txns = df.groupBy(ID).agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("n_txn"))
    return wide.crossJoin(txns).withColumn("n_nodes", F.col("n_txn") + F.col("n_entities"))


def entity_stats(e: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Transactions and labels per entity value; `e` carries the label."""
    return e.groupBy("subtype", "value", *(extra or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(LABEL).cast("double"), F.lit(0.0))).alias("hits"))


def entity_degrees(train: DataFrame, rows: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """`entity_degree_{e}`: training transactions sharing the row's value; NULL if unseen or NULL."""
    deg = edges(train, entities).groupBy("subtype", "value").agg(F.count(F.lit(1)).alias("n"))
    hit = edges(rows, entities).join(deg, ["subtype", "value"])
    blank = rows.select(F.col(ID).alias("txn"), F.lit(None).cast("string").alias("subtype"), F.lit(None).cast("long").alias("n"))
    both = hit.select("txn", "subtype", "n").unionByName(blank)
    return both.groupBy("txn").agg(*[F.max(F.when(F.col("subtype") == e, F.col("n"))).alias(f"entity_degree_{e}") for e in entities]).withColumnRenamed("txn", ID)


def neighbour_rate(train: DataFrame, rows: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """Labels over transactions summed across the row's training entity values; NULL without any."""
    stats = entity_stats(edges(train, entities, [LABEL]))
    hit = edges(rows, entities).join(stats, ["subtype", "value"])
    rate = hit.groupBy("txn").agg(ratio(F.sum("hits"), F.sum("n")).alias("fraud_neighbor_rate"))
    return rows.select(ID).join(rate.withColumnRenamed("txn", ID), ID, "left")


def neighbour_rate_out_of_fold(df: DataFrame, entities: list[str] = ENTITIES, folds: int = config.N_FOLDS) -> DataFrame:
    """The same from the other folds' transactions only: totals minus the row's own fold."""
    x = df.withColumn("fold", hash_fold(k=folds))
    e = edges(x, entities, [LABEL, "fold"])
    own = entity_stats(e, ["fold"])
    total = own.groupBy("subtype", "value").agg(F.sum("n").alias("tn"), F.sum("hits").alias("th"))
    other = own.join(total, ["subtype", "value"]).select("subtype", "value", "fold", (F.col("tn") - F.col("n")).alias("n"), (F.col("th") - F.col("hits")).alias("hits"))
    hit = e.select("txn", "subtype", "value", "fold").join(other, ["subtype", "value", "fold"])
    rate = hit.groupBy("txn").agg(ratio(F.sum("hits"), F.sum("n")).alias("fraud_neighbor_rate"))
    return df.select(ID).join(rate.withColumnRenamed("txn", ID), ID, "left")


def _nodes(entities: list[str]) -> Column:
    """The row's entity nodes as sorted strings."""
    return F.array_sort(F.array_compact(F.array(*[F.concat(F.lit(e + _SEP), F.col(e).cast("string")) for e in entities])))


def _stored_pairs(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The written pairs, and their number and XOR of hashes: equal when nothing changed."""
    df, seen = cut_lineage(pairs, "components", n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("u", "v")))
    return df, (seen["n"], seen["x"])


def node_number(node: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), node)


def entity_components(df: DataFrame, entities: list[str] = ENTITIES, max_rounds: int = 60) -> DataFrame:
    """(node, i, root): the number of every entity node, and a common root number for all that are connected.

    Transactions are contracted first: each becomes at most len(entities) - 1 links between its own
    entity nodes, and distinct links are far fewer than rows. A node's number is a hash of its text, so
    links are made of numbers where rows are read; the distinct nodes tell whether two share a hash, and
    another seed is taken then. Alternating large-star and small-star rounds shrink the links to stars;
    every round is written out, which cuts the plan and survives lost executors.
    """
    linked = df.select(_nodes(entities).alias("nodes")).where(F.size("nodes") > 0)
    for seed in range(8):
        members, seen = cut_lineage(linked.select(F.explode("nodes").alias("node")).distinct().withColumn("i", node_number(F.col("node"), seed)), "nodes", n=F.count(F.lit(1)))
        if members.select("i").distinct().count() == seen["n"]:
            break
    else:
        raise RuntimeError("node hashes keep colliding")
    numbers = F.transform("nodes", lambda x: node_number(x, seed))
    star = linked.where(F.size("nodes") > 1).select(numbers.alias("k")).select(F.col("k")[0].alias("a"), F.explode(F.slice("k", F.lit(2), F.size("k") - 1)).alias("b"))
    pairs, seen = _stored_pairs(star.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        # Large star: every larger neighbour of a node links to the smallest node around it.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs, now = _stored_pairs(small.where(F.col("u") != F.col("v")).distinct())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    found = members.join(pairs.select(F.col("u").alias("i"), "v"), "i", "left")
    return found.select("node", "i", F.coalesce("v", "i").alias("root"))


def component_sizes(df: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """`connected_component_size` per transaction: transactions plus entity values of its component."""
    first = F.get(_nodes(entities), F.lit(0))
    rows = df.select(ID, first.alias("node"))
    comp = cut_lineage(entity_components(df, entities), "component-labels")
    # Transactions are counted per entity value before they meet the component table.
    held = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    size = comp.join(held, "node", "left").groupBy("root").agg((F.count(F.lit(1)) + F.coalesce(F.sum("t"), F.lit(0))).alias("size"))
    by_node = comp.join(size, "root").select("node", "size")
    hit = rows.where(F.col("node").isNotNull()).join(by_node, "node").select(ID, "size")
    alone = rows.where(F.col("node").isNull()).select(ID, F.lit(1).cast("long").alias("size"))
    return hit.unionByName(alone).withColumnRenamed("size", "connected_component_size")


def component_table(df: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """One row per component: number of nodes and transactions; isolated transactions included."""
    first = F.get(_nodes(entities), F.lit(0))
    rows = df.select(ID, first.alias("node"))
    comp = cut_lineage(entity_components(df, entities), "component-labels")
    held = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    linked = comp.join(held, "node", "left").groupBy("root").agg(
        (F.count(F.lit(1)) + F.coalesce(F.sum("t"), F.lit(0))).alias("n_nodes"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_txn"))
    alone = rows.where(F.col("node").isNull()).select((-F.monotonically_increasing_id() - 1).alias("root"), F.lit(1).cast("long").alias("n_nodes"), F.lit(1).cast("long").alias("n_txn"))
    return linked.unionByName(alone)


def page_rank(df: DataFrame, entities: list[str] = ENTITIES, damping: float = DAMPING, max_iterations: int = MAX_ITERATIONS,
              tolerance: float | None = None) -> tuple[DataFrame, int]:
    """(`pagerank_score` per transaction, iterations). Undirected; isolated transactions are dangling.

    The rank is iterated until it has settled (`_settled_rank`). A `tolerance` asks for plain rounds instead, at most
    `max_iterations`, that stop once the summed change is below nodes * tolerance; without convergence every score is
    1 / nodes. As ranks add up to 1, that stop ends a graph of 2 / tolerance nodes or more after its first round.
    """
    named = edges(df, entities).select("txn", F.concat_ws(_SEP, "subtype", "value").alias("node"))
    for seed in range(8):
        e = cut_lineage(named.withColumn("ent", node_number(F.col("node"), seed)), "rank-edges")
        held = e.select("node", "ent").distinct().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ent").alias("d")).first()
        if held["n"] == held["d"]:
            break
    else:
        raise RuntimeError("node hashes keep colliding")
    e = e.select("txn", "ent")
    ent_deg = e.groupBy("ent").agg(F.count(F.lit(1)).alias("deg"))
    txn_deg = e.groupBy("txn").agg(F.count(F.lit(1)).alias("deg"))
    # Nodes from the stored edges: all transactions, and entities with an edge.
    n = df.select(F.count_distinct(ID)).first()[0] + held["n"]
    if tolerance is None:
        return _settled_rank(df, e, ent_deg, n, damping)
    txns = df.select(F.col(ID).alias("txn")).join(txn_deg, "txn", "left")
    ranks_t = txns.select("txn", "deg", F.lit(1.0 / n).alias("rank"))
    ranks_e = ent_deg.select("ent", "deg", F.lit(1.0 / n).alias("rank"))
    for i in range(1, max_iterations + 1):
        # Rank held by isolated transactions is spread over all nodes; kept as a one-row frame.
        loose = ranks_t.where(F.col("deg").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        base = damping * F.col("loose") / n + (1.0 - damping) / n

        give_t = ranks_t.where(F.col("deg").isNotNull()).select("txn", (F.col("rank") / F.col("deg")).alias("g"))
        give_e = ranks_e.select("ent", (F.col("rank") / F.col("deg")).alias("g"))
        to_e = e.join(give_t, "txn").groupBy("ent").agg(F.sum("g").alias("s"))
        to_t = e.join(give_e, "ent").groupBy("txn").agg(F.sum("g").alias("s"))
        new_e = ranks_e.withColumnRenamed("rank", "old").join(to_e, "ent").crossJoin(loose)
        new_t = ranks_t.withColumnRenamed("rank", "old").join(to_t, "txn", "left").crossJoin(loose)
        moved = F.sum(F.abs(F.col("rank") - F.col("old")))
        new_e, seen_e = cut_lineage(new_e.select("ent", "deg", "old", (damping * F.col("s") + base).alias("rank")), "rank", moved=moved)
        new_t, seen_t = cut_lineage(new_t.select("txn", "deg", "old", (damping * F.coalesce("s", F.lit(0.0)) + base).alias("rank")), "rank", moved=moved)
        ranks_e, ranks_t = new_e.drop("old"), new_t.drop("old")
        if (seen_e["moved"] or 0.0) + (seen_t["moved"] or 0.0) < n * tolerance:
            return ranks_t.select(F.col("txn").alias(ID), F.col("rank").alias("pagerank_score")), i
    return df.select(ID, F.lit(1.0 / n).alias("pagerank_score")), max_iterations


def _settled_rank(df: DataFrame, e: DataFrame, ent_deg: DataFrame, n: int, damping: float) -> tuple[DataFrame, int]:
    """The rank that rounds over the edges (txn, ent) lead to, whatever their number, and the rounds taken.

    Two plain rounds lead from entities over transactions back to entities, so the entities' ranks are iterated alone,
    and transactions with the same entities are one link with a weight. The map of two rounds has real eigenvalues
    between 0 and damping ** 2, as the graph is undirected; Chebyshev steps make use of it and shrink the error to less
    than a third a round, where plain rounds swing between both sides of the graph. The end is reached when two more
    plain rounds would change no entity's rank by more than `SETTLED` of it. A transaction id is one node, however many
    rows hold it; rows without an id get the rank of an isolated transaction.
    """
    known = e.where(F.col("txn").isNotNull())
    groups = known.groupBy("txn").agg(F.sort_array(F.collect_list("ent")).alias("ents")).groupBy("ents").agg(F.min("txn").alias("k"), F.count(F.lit(1)).alias("m"))
    links, linked = cut_lineage(groups.select("k", "m", (F.col("m") / F.size("ents")).alias("w"), "ents"), "rank-links", n=F.sum("m"))
    links = links.select("k", "w", F.explode("ents").alias("ent"))
    # Isolated transactions keep what they spread over all nodes in the end: the share of a node without edges.
    alone = df.select(F.count_distinct(ID)).first()[0] - (linked["n"] or 0)
    base = (1.0 - damping) / (n - damping * alone)
    reach = damping * damping
    fixed = ent_deg.join(links.groupBy("ent").agg(F.sum("w").alias("w")), "ent", "left").select(
        "ent", "deg", (base * (1.0 + damping * F.coalesce("w", F.lit(0.0)))).alias("own"))
    ranks = fixed.withColumn("rank", F.col("own") / (1.0 - reach)).withColumn("old", F.col("rank"))
    ranks = cut_lineage(ranks, "rank")
    spread, weight = reach / (2.0 - reach), 2.0
    for i in range(1, SETTLED_ROUNDS + 1):
        give = ranks.select("ent", (F.col("rank") / F.col("deg")).alias("g"))
        held = links.join(give, "ent").groupBy("k").agg(F.sum("g").alias("s"))
        back = links.join(held, "k").groupBy("ent").agg(F.sum(F.col("w") * F.col("s")).alias("s"))
        plain = reach * F.coalesce("s", F.lit(0.0)) + F.col("own")
        step = weight if i > 1 else 1.0
        ahead = step * ((2.0 * F.col("plain") - reach * F.col("rank")) / (2.0 - reach) - F.col("old")) + F.col("old")
        moved = F.max(F.abs(F.col("plain") - F.col("was")) / F.greatest("was", F.lit(base)))
        after = ranks.join(back, "ent", "left").withColumn("plain", plain).select("ent", "deg", "own", "plain", F.col("rank").alias("was"), ahead.alias("rank"))
        after, seen = cut_lineage(after, "rank", moved=moved)
        if (seen["moved"] or 0.0) < SETTLED:
            break
        ranks = after.withColumnRenamed("was", "old").drop("plain")
        weight = 1.0 / (1.0 - spread * spread * weight / 4.0)
    else:
        raise RuntimeError("rank did not settle")
    give = after.select("ent", (F.col("plain") / F.col("deg")).alias("g"))
    score = known.join(give, "ent").groupBy("txn").agg((damping * F.sum("g") + base).alias("rank"))
    rows = df.select(F.col(ID).alias("txn")).join(score, "txn", "left")
    return cut_lineage(rows.select(F.col("txn").alias(ID), F.coalesce("rank", F.lit(base)).alias("pagerank_score")), "rank-rows"), i


def _overlap_weight(shared: int, own: Column, size: int, most: int) -> Column:
    """Inclusion-exclusion weight of a transaction found under a subset of `shared` entities."""
    out = None
    for d in range(1, most + 1):
        total = 0.0
        for t in range(1, shared + 1):
            if d + size - t > 0:
                total += (-1) ** (shared - t) * math.comb(shared, t) * t / (d + size - t)
        out = F.when(own == d, F.lit(total)) if out is None else out.when(own == d, F.lit(total))
    return out


def clustering(df: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """`clustering_coefficient`: mean overlap |shared| / |either| of entity sets with transactions two steps away.

    No pair of transactions is formed. How many transactions share at least a given subset of the
    row's entity values is a plain group count; over the at most 15 subsets, inclusion-exclusion turns
    these counts into the number sharing exactly k values, which fixes every overlap. The work grows
    with the rows, so it is done at every size.
    """
    text = [F.col(e).cast("string").alias(e) for e in entities]
    degree = sum((F.col(e).isNotNull().cast("int") for e in entities), F.lit(0))
    # Identical entity tuples behave alike: count them once.
    tuples = df.select(*text).groupBy(*entities).agg(F.count(F.lit(1)).alias("m")).withColumn("d", degree)
    most = len(entities)
    subsets = [list(c) for k in range(1, most + 1) for c in combinations(entities, k)]
    choices = F.array(*[
        F.when(F.greatest(*[F.col(e).isNull() for e in s], F.lit(False)), F.lit(None)).otherwise(
            F.struct(F.lit("+".join(s)).alias("subset"), F.lit(len(s)).alias("s"), F.concat_ws(_SEP, *s).alias("key")))
        for s in subsets
    ])
    opened = tuples.where(F.col("d") > 0).select(*entities, "m", "d", F.explode(F.array_compact(choices)).alias("c")).select(*entities, "m", "d", "c.*")
    counts = opened.groupBy("subset", "key").agg(*[F.sum(F.when(F.col("d") == k, F.col("m")).otherwise(0)).alias(f"n{k}") for k in range(1, most + 1)])
    j = opened.join(counts, ["subset", "key"])
    overlap = F.lit(0.0)
    reached = F.lit(0.0)
    for k in range(1, most + 1):
        weight = None
        for s in range(1, most + 1):
            w = _overlap_weight(s, F.col("d"), k, most)
            weight = F.when(F.col("s") == s, w) if weight is None else weight.when(F.col("s") == s, w)
        overlap = overlap + F.col(f"n{k}") * weight
        reached = reached + F.col(f"n{k}")
    sign = F.when(F.col("s") % 2 == 1, 1.0).otherwise(-1.0)
    per = j.groupBy(*entities).agg(F.sum(overlap).alias("total"), F.sum(reached * sign).alias("others"))
    value = F.when(F.col("others") > 1.5, (F.col("total") - 1.0) / (F.col("others") - 1.0)).otherwise(0.0)
    per = per.select(*[F.col(e).alias(f"_{e}") for e in entities], value.alias("clustering_coefficient"))
    same = F.lit(True)
    for e in entities:
        same = same & F.col(e).cast("string").eqNullSafe(F.col(f"_{e}"))
    return df.select(ID, *entities).join(per, same, "left").select(ID, F.coalesce("clustering_coefficient", F.lit(0.0)).alias("clustering_coefficient"))


def held_out_features(train: DataFrame, rows: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """Held-out rows know their entities only: structure is NULL, degrees and rates come from training."""
    out = entity_degrees(train, rows, entities).join(neighbour_rate(train, rows, entities), ID)
    return out.withColumns({
        "connected_component_size": F.lit(None).cast("long"), "pagerank_score": F.lit(None).cast("double"),
        "clustering_coefficient": F.lit(None).cast("double")})


def vocabulary(frames: list[DataFrame], column: str) -> DataFrame:
    """(value, idx): distinct non-null values of all frames in order, numbered from 1."""
    values = None
    for df in frames:
        one = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
        values = one if values is None else values.unionByName(one)
    return dense_index(values.distinct(), ["value"])


def encode(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    """Index of the value; 0 for NULL or unknown."""
    return df.join(vocab.select(F.col("value").alias(column), F.col("idx").alias(out)), column, "left").fillna(0, [out])


def indexed_edges(df: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """(src, dst) in both directions: transactions first, then each entity's values, numbered from 0."""
    e = edges(df, entities)
    txns = dense_index(df.select(F.col(ID).alias("txn")).distinct(), ["txn"], "src", start=0)
    # Values follow the order of the entity columns, numbers by size and text by letters.
    numeric = [n for n, t in df.dtypes if n in entities and t != "string"]
    place = F.array_position(F.array(*[F.lit(x) for x in entities]), F.col("subtype"))
    number = F.when(F.col("subtype").isin(numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")
    values = e.select("subtype", "value").distinct().withColumns({"place": place, "number": number})
    values = dense_index(values, ["place", "number", "value"], "pos", start=0).drop("place", "number")
    offset = txns.agg(F.count(F.lit(1)).alias("n_txn"))
    forward = e.join(txns, "txn").join(values, ["subtype", "value"]).crossJoin(offset).select("src", (F.col("pos") + F.col("n_txn")).alias("dst"))
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
