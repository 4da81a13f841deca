"""Schema rules, lineage records and type tightening."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


@dataclass
class Rule:
    """What a column, or every column matching `pattern`, must satisfy."""

    name: str
    dtype: str | None = None  # "long", "double" or "string" family
    nullable: bool = True
    required: bool = True
    unique: bool = False
    pattern: bool = False
    one_of: list | None = None
    at_least: float | None = None
    above: float | None = None
    at_most: float | None = None


@dataclass
class Contract:
    """A named, versioned set of rules; columns without a rule pass."""

    name: str
    version: int = 1
    rules: list[Rule] = field(default_factory=list)

    def extend(self, name: str, rules: list[Rule]) -> Contract:
        return Contract(name, self.version, [*self.rules, *rules])

    def without(self, columns: list[str]) -> Contract:
        return Contract(self.name, self.version, [r for r in self.rules if r.name not in columns])


_FAMILIES = {"long": INTEGRAL, "double": ("float", "double", *INTEGRAL), "string": ("string",)}


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """All broken rules as (rule, column, n_bad). One aggregation for all value rules."""
    types = dict(df.dtypes)
    fixed: list[tuple[str, str, int]] = []
    counted: list[tuple[str, str, Column]] = []
    unique: list[str] = []
    for r in contract.rules:
        names = [c for c in df.columns if re.match(r.name, c)] if r.pattern else [r.name]
        for c in names:
            if c not in types:
                if r.required:
                    fixed.append(("required", c, 1))
                continue
            col = F.col(f"`{c}`")
            if r.dtype and types[c] not in _FAMILIES[r.dtype]:
                fixed.append(("dtype", c, 1))
                continue
            if not r.nullable:
                counted.append(("not_null", c, col.isNull()))
            if r.one_of is not None:
                counted.append(("one_of", c, ~col.isin(r.one_of)))
            if r.at_least is not None:
                counted.append(("at_least", c, col < r.at_least))
            if r.above is not None:
                counted.append(("above", c, col <= r.above))
            if r.at_most is not None:
                counted.append(("at_most", c, col > r.at_most))
            if r.unique:
                unique.append(c)
    spark = df.sparkSession
    out = spark.createDataFrame(fixed, "rule string, column string, n_bad long")
    if counted:
        wide = df.agg(*[F.count_if(cond).alias(f"r{i}") for i, (_, _, cond) in enumerate(counted)])
        long = wide.select(F.explode(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), F.col(f"r{i}").alias("n_bad")) for i, (rule, c, _) in enumerate(counted)
        ])).alias("x")).select("x.*")
        out = out.unionByName(long)
    for c in unique:
        # Rows beyond the first of each value, counted by a partial aggregation.
        extra = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("n_bad"))
        out = out.unionByName(extra.select(F.lit("unique").alias("rule"), F.lit(c).alias("column"), F.coalesce("n_bad", F.lit(0)).alias("n_bad")))
    return out.where(F.col("n_bad") > 0)


# The raw table's allowed codes.
PRODUCT_CODES = ["C", "H", "R", "S", "W"]
CARD4_BRANDS = ["american express", "discover", "mastercard", "visa"]
CARD6_TYPES = ["charge card", "credit", "debit", "debit or credit"]

# Which identity columns hold text; the others of id_01 to id_38 hold numbers.
IDENTITY_TEXTS = [f"id_{k:02d}" for k in (12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38)]
IDENTITY_NUMBERS = [c for c in (f"id_{k:02d}" for k in range(1, 39)) if c not in IDENTITY_TEXTS]

RAW_TRANSACTIONS = Contract("raw_transactions", 1, [
    Rule("TransactionID", "long", nullable=False, unique=True),
    Rule("isFraud", "long", nullable=False, one_of=[0, 1]),
    Rule("TransactionDT", "long", nullable=False, at_least=0),
    Rule("TransactionAmt", "double", nullable=False, above=0.0),
    Rule("ProductCD", "string", nullable=False, one_of=PRODUCT_CODES),
    Rule("card1", "long", nullable=False),
    *[Rule(c, "double") for c in ("card2", "card3", "card5", "addr1", "addr2")],
    Rule("card4", "string", one_of=CARD4_BRANDS),
    Rule("card6", "string", one_of=CARD6_TYPES),
    *[Rule(c, "double", required=False) for c in ("dist1", "dist2")],
    *[Rule(c, "string") for c in ("P_emaildomain", "R_emaildomain")],
    *[Rule(p, "double", required=False, pattern=True) for p in (r"^C\d{1,2}$", r"^D\d{1,2}$", r"^V\d{1,3}$")],
    Rule(r"^M[1-35-9]$", "string", required=False, pattern=True, one_of=["F", "T"]),
    Rule("M4", "string", required=False, one_of=["M0", "M1", "M2"]),
])
RAW_IDENTITY = Contract("raw_identity", 1, [
    Rule("TransactionID", "long", nullable=False, unique=True),
    *[Rule(c, "string", required=False) for c in ("DeviceType", "DeviceInfo")],
    *[Rule(c, "double", required=False) for c in IDENTITY_NUMBERS],
    *[Rule(c, "string", required=False) for c in IDENTITY_TEXTS],
])
MERGED = RAW_TRANSACTIONS.extend("merged", RAW_IDENTITY.rules[1:])
INTERIM = MERGED.extend("interim", [
    Rule("timestamp", nullable=False),
    Rule("hour", "long", nullable=False, at_least=0, at_most=23),
    Rule("day_of_week", "long", nullable=False, at_least=0, at_most=6),
    Rule("is_weekend", "long", nullable=False, one_of=[0, 1]),
])
_FLAG = {"one_of": [0, 1]}
FEATURE_TIER_1 = INTERIM.extend("tier1", [
    Rule("log_amount", "double", nullable=False, at_least=0.0),
    Rule("amount_decile", "long", nullable=False, at_least=0, at_most=9),
    Rule("hour_of_day", "long", nullable=False, at_least=0, at_most=23),
    Rule("is_business_hours", "long", nullable=False, **_FLAG),
    Rule("hour_sin", "double", nullable=False, at_least=-1.0, at_most=1.0),
    Rule("hour_cos", "double", nullable=False, at_least=-1.0, at_most=1.0),
    Rule(r"^[PR]_emaildomain_is_(free|disposable)$", "long", required=False, pattern=True, **_FLAG),
    Rule(r"^is_null_.*$", "long", required=False, pattern=True, nullable=False, **_FLAG),
])
FEATURE_TIER_2 = FEATURE_TIER_1.extend("tier2", [
    Rule(r"^.*_velocity_(1h|24h|7d)$", "long", required=False, pattern=True, nullable=False, at_least=0),
    Rule(r"^.*_amt_(mean|std|max)_30d$", "double", required=False, pattern=True),
    Rule(r"^.*_target_enc$", "double", required=False, pattern=True, nullable=False, at_least=0.0, at_most=1.0),
])
FEATURE_TIER_3 = FEATURE_TIER_2.extend("tier3", [
    Rule("amt_zscore_vs_card1_history", "double", nullable=False),
    Rule("time_since_last_txn_zscore", "double", nullable=False),
    Rule("addr_change_flag", "long", nullable=False, **_FLAG),
    Rule("device_change_flag", "long", nullable=False, **_FLAG),
    Rule("hour_deviation", "double", nullable=False, at_least=0.0, at_most=24.0),
    Rule(r"^is_coldstart_.*$", "long", required=False, pattern=True, nullable=False, **_FLAG),
])
FEATURE_TIER_4 = FEATURE_TIER_3.extend("tier4", [Rule(r"^.*_v_ewm_lambda_.*$", "double", required=False, pattern=True, nullable=False, at_least=0.0)])
FEATURE_TIER_5 = FEATURE_TIER_4.extend("tier5", [
    Rule("connected_component_size", "long", at_least=1),
    Rule("pagerank_score", "double", at_least=0.0, at_most=1.0),
    Rule("clustering_coefficient", "double", at_least=0.0, at_most=1.0),
    Rule("fraud_neighbor_rate", "double", at_least=0.0, at_most=1.0),
    Rule(r"^entity_degree_.*$", "long", required=False, pattern=True, at_least=0),
])


def fingerprint(df: DataFrame) -> str:
    """First 16 hex digits of the hash of sorted (name, type) pairs."""
    body = json.dumps(sorted([n, t] for n, t in df.dtypes), separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()[:16]


LINEAGE_SCHEMA = ("step string, input_rows long, output_rows long, input_schema string, output_schema string, "
                  "duration_ms long, finished_at timestamp")


def traced(step: str, df: DataFrame, fn: Callable[[DataFrame], DataFrame], run: Callable[[DataFrame], None]) -> DataFrame:
    """Apply `fn`, write its result with `run`, and return one lineage row.

    Rows are counted while the write reads and writes them, so no scan is added.
    """
    start, before, after = time.time(), Observation(), Observation()
    out = fn(df.observe(before, F.count(F.lit(1)).alias("n"))).observe(after, F.count(F.lit(1)).alias("n"))
    run(out)
    spark = df.sparkSession
    row = [(step, before.get["n"], after.get["n"], fingerprint(df), fingerprint(out), int((time.time() - start) * 1000))]
    return spark.createDataFrame(row, LINEAGE_SCHEMA.rsplit(",", 1)[0]).withColumn("finished_at", F.current_timestamp())


def lineage_failures(steps: DataFrame, stored: DataFrame, manifest_version: int, expected_version: int = 1) -> DataFrame:
    """Broken lineage contracts as (contract, detail).

    `steps` has one row per step, `stored` one row per split with its stored row count; both are tiny.
    """
    def rows(step: str, side: str) -> Column:
        return F.max(F.when(F.col("step") == step, F.col(side)))

    needed = ["load_merged", "interim_clean", "split_train", "split_val", "split_test"]
    s = steps.agg(
        F.collect_set("step").alias("have"), rows("load_merged", "output_rows").alias("load_out"),
        rows("interim_clean", "input_rows").alias("clean_in"), rows("interim_clean", "output_rows").alias("clean_out"),
        *[rows(f"split_{x}", "output_rows").alias(x) for x in ("train", "val", "test")])
    p = stored.agg(*[F.max(F.when(F.col("split") == x, F.col("rows"))).alias(f"stored_{x}") for x in ("train", "val", "test")])
    j = s.crossJoin(p)
    missing = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in needed]), F.col("have")))
    # A split must be stored; its rows are compared where its step was recorded.
    wrong = [F.when(F.col(f"stored_{x}").isNull() | (F.col(f"stored_{x}") != F.col(x)), F.lit(x)) for x in ("train", "val", "test")]
    wrong_splits = F.array_compact(F.array(*wrong))

    def check(contract: str, broken: Column, *detail: Column) -> Column:
        text = F.concat_ws("/", *[d.cast("string") for d in detail])
        return F.struct(F.lit(contract).alias("contract"), broken.alias("broken"), text.alias("detail"))

    checks = F.array(
        check("steps_present", F.size(missing) > 0, F.concat_ws(",", missing)),
        check("load_feeds_clean", F.col("load_out") != F.col("clean_in"), F.col("load_out"), F.col("clean_in")),
        check("clean_only_drops", F.col("clean_out") > F.col("clean_in"), F.col("clean_out"), F.col("clean_in")),
        check("splits_sum", F.col("train") + F.col("val") + F.col("test") != F.col("clean_out"), F.col("clean_out")),
        check("stored_rows", F.size(wrong_splits) > 0, F.concat_ws(",", wrong_splits)),
        check("manifest_version", F.lit(manifest_version != expected_version), F.lit(manifest_version)),
    )
    return j.select(F.explode(checks).alias("c")).where(F.col("c.broken")).select("c.contract", "c.detail")


def narrow_types(df: DataFrame, max_distinct_share: float = 0.5) -> DataFrame:
    """Per column the narrowest type that holds it: (column, from_type, to_type)."""
    types = dict(df.dtypes)
    ints = [c for c, t in types.items() if t in INTEGRAL]
    texts = [c for c, t in types.items() if t == "string"]
    floats = [c for c, t in types.items() if t in ("float", "double")]
    spark = df.sparkSession
    parts = []
    if ints:
        wide = df.agg(*[F.struct(F.min(c).cast("long").alias("lo"), F.max(c).cast("long").alias("hi")).alias(c) for c in ints])
        lo, hi = F.col("s.lo"), F.col("s.hi")
        pick = F.when(lo.isNull(), F.col("from_type"))
        for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            pick = pick.when((lo >= -(2**bits)) & (hi <= 2**bits - 1), name)
        parts.append(wide.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("from_type"), F.col(c).alias("s")) for c in ints])).alias("x"))
            .select("x.*").select("column", "from_type", pick.otherwise("bigint").alias("to_type")))
    if floats:
        parts.append(spark.createDataFrame([(c, types[c], "float") for c in floats], "column string, from_type string, to_type string"))
    if texts:
        # Distinct (column, value) pairs are reduced before they are counted; n = 0 leaves the type alone.
        values = df.unpivot([], texts, "column", "v").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        share = values.groupBy("column").agg(F.count("v").alias("distinct"), F.sum("n").alias("n"))
        parts.append(share.select("column", F.lit("string").alias("from_type"),
                                  F.when(F.col("distinct") / F.col("n") < max_distinct_share, "category").otherwise("string").alias("to_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_types(df: DataFrame, plan: list[tuple[str, str]]) -> DataFrame:
    """Cast to the chosen types; Spark keeps categories as strings (Parquet stores them by dictionary)."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in plan if t not in ("category", "string")})
