"""Feature generators composed into one job: learn on the training rows, apply to later rows.

Generators that look at other rows work on a narrow projection and hand back frames keyed by the
transaction. `fit_transform` joins these frames lazily. `slices` is the way for large tables: the rows and the
frame of every tier are written in equal buckets of the transaction id, all past features come from one table of
instants for training and later rows together, and the tiers are joined bucket by bucket, without a shuffle of the
wide rows.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial
from typing import Protocol

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import basic as B
from tidemark.operators import encode as E
from tidemark.operators import graph as G
from tidemark.operators import model as L
from tidemark.operators import pastpass as P
from tidemark.operators import reduce as R
from tidemark.operators import velocity as V
from tidemark.operators.buckets import BucketedTables
from tidemark.operators.profile import numbered

ID, SLICE, LATER = "TransactionID", "slice", "later__"
TIERS_AT_ONCE = 4  # tiers whose jobs are submitted together


class FeatureGenerator(Protocol):
    """`fit` learns from training rows; `own` gives the training rows' features, `later` those of other rows.

    Both return frames keyed by the transaction id; `history` holds rows whose past counts for `later`.
    A generator that never looks at the V block may say so by an attribute `narrow`.
    """

    rationale: str

    def fit(self, train: DataFrame) -> None: ...

    def own(self, train: DataFrame) -> DataFrame: ...

    def later(self, rows: DataFrame, history: DataFrame | None) -> DataFrame: ...


def _with_history(rows: DataFrame, history: DataFrame | None, compute) -> DataFrame:
    """Compute on the rows alone, or on rows and history together and keep the rows."""
    if history is None:
        return compute(rows)
    both = history.unionByName(rows, allowMissingColumns=True)
    return compute(both).join(rows.select(ID), ID, "left_semi")


@dataclass
class Amount:
    rationale: str = "Size of the payment on a log scale and by decile."
    edges: list[float] = field(default_factory=list)

    def fit(self, train):
        self.edges = B.decile_edges(train)

    def add(self, rows):
        return B.amount_decile(B.log_amount(rows), self.edges)

    def own(self, rows):
        return self.add(rows).select(ID, "log_amount", "amount_decile")

    def later(self, rows, history):
        return self.own(rows)


@dataclass
class Calendar:
    rationale: str = "Hour, weekday and office hours of the payment."

    def fit(self, train):
        pass

    def add(self, rows):
        return B.calendar_set(rows)

    def own(self, rows):
        return self.add(rows).select(ID, "hour_of_day", "day_of_week", "is_weekend", "is_business_hours", "hour_sin", "hour_cos")

    def later(self, rows, history):
        return self.own(rows)


@dataclass
class Mail:
    columns: tuple[str, ...] = ("P_emaildomain", "R_emaildomain")
    rationale: str = "Provider, ending and kind of the mail domain."

    def fit(self, train):
        pass

    def add(self, rows):
        for c in self.columns:
            rows = B.mail_columns(rows, c) if c in rows.columns else rows
        return rows

    def own(self, rows):
        present = [c for c in self.columns if c in rows.columns]
        return self.add(rows).select(ID, *[f"{c}_{s}" for c in present for s in ("provider", "tld", "is_free", "is_disposable")])

    def later(self, rows, history):
        return self.own(rows)


@dataclass
class Missing:
    rationale: str = "Which often missing columns are missing here."
    columns: list[str] = field(default_factory=list)

    def fit(self, train):
        self.columns = B.columns_often_missing(train)

    def add(self, rows):
        return B.missing_indicators(rows, self.columns)

    def own(self, rows):
        return self.add(rows).select(ID, *[f"is_null_{c}" for c in self.columns])

    def later(self, rows, history):
        return self.own(rows)


@dataclass
class Past:
    """A stateless feature of the strict past."""

    compute: object
    rationale: str
    family: str  # its name in `pastpass`, which makes several of them in one pass
    narrow = True

    def fit(self, train):
        pass

    def own(self, rows):
        return self.compute(rows)

    def later(self, rows, history):
        return _with_history(rows, history, self.compute)


def _behaviour(rows: DataFrame) -> DataFrame:
    timed = B.calendar_set(rows) if "hour_of_day" not in rows.columns else rows
    return V.zscores(timed).join(V.address_change(timed), ID).join(V.device_change(timed), ID)


@dataclass
class Encoding:
    columns: tuple[str, ...] = ("card4", "addr1", "P_emaildomain")
    rationale: str = "Smoothed label rate of the category, from other folds on the training rows."
    tables: dict = field(default_factory=dict)
    prior: DataFrame | None = None
    absent: tuple[str, ...] = ()  # configured columns that the training rows lack

    @property
    def narrow(self) -> bool:
        return not numbered(list(self.columns))

    def fit(self, train):
        self.absent = tuple(c for c in self.columns if c not in train.columns)
        if self.absent:
            warnings.warn(f"no encoding for columns that the training rows lack: {', '.join(self.absent)}", stacklevel=2)
        self.columns = tuple(c for c in self.columns if c in train.columns)
        self.prior = train.agg(F.avg(F.col("isFraud").cast("double")).alias("prior"))
        self.tables = {c: E.fit_encoding(train, c) for c in self.columns}

    def own(self, rows):
        return E.out_of_fold(rows, list(self.columns)).select(ID, *[f"{c}_target_enc" for c in self.columns])

    def later(self, rows, history):
        out = rows
        for c in self.columns:
            out = E.apply_encoding(out, c, self.tables[c], self.prior)
        return out.select(ID, *[f"{c}_target_enc" for c in self.columns])


@dataclass
class Decay:
    rationale: str = "Decayed counts and labels of the entity's past."
    state: DataFrame | None = None
    family: str = "decay"
    narrow = True

    def fit(self, train):
        self.state = V.ewm_end_state(train)

    def own(self, rows):
        return V.ewm(rows)

    def later(self, rows, history):
        return V.ewm_held_out(rows, self.state).drop("backward_rows")


@dataclass
class Graph:
    rationale: str = "Shared entities: degree, neighbours' labels, component, rank, clustering."
    train: DataFrame | None = None

    def fit(self, train):
        self.train = train

    def own(self, rows):
        ranks, _ = G.page_rank(rows)
        return (G.entity_degrees(rows, rows).join(G.neighbour_rate_out_of_fold(rows), ID).join(G.component_sizes(rows), ID)
                .join(ranks, ID).join(G.clustering(rows), ID))

    def later(self, rows, history):
        return G.held_out_features(self.train, rows)


DEFAULT = [
    ("amount", Amount), ("calendar", Calendar), ("mail", Mail), ("missing", Missing),
    ("velocity", lambda: Past(V.velocity, "How often the entity was seen lately.", "velocity")),
    ("stats", lambda: Past(V.amount_stats, "Level and spread of the entity's recent amounts.", "stats")),
    ("encoding", Encoding),
    ("behaviour", lambda: Past(_behaviour, "Departure from the card's own habits.", "behaviour")),
    ("cold_start", lambda: Past(V.cold_start, "Whether the card has any history.", "cold_start")),
    ("decay", Decay), ("graph", Graph),
]


class FeatureChain:
    """Named generators in order, and the thinning of the V block at the end, which can be left out."""

    def __init__(self, parts: list[tuple[str, FeatureGenerator]] | None = None, thin_columns: bool = True):
        self.parts = parts if parts is not None else [(n, make()) for n, make in DEFAULT]
        self.thin_columns = thin_columns
        self.groups: list[R.Group] = []
        self.dropped: list[str] = []
        self.features: list[tuple[str, str, str, str]] = []

    def _join(self, rows: DataFrame, frames: list[DataFrame]) -> DataFrame:
        wide = frames[0]
        for f in frames[1:]:
            wide = wide.join(f, ID, "left")
        return rows.join(wide, ID, "left")

    def fit_transform(self, train: DataFrame) -> DataFrame:
        frames, self.features = [], []
        for name, part in self.parts:
            part.fit(train)
            frame = part.own(train)
            frames.append(frame)
            self.features += [(name, c, t, part.rationale) for c, t in frame.dtypes if c != ID]
        out = self._join(train, frames)
        self._thin(train)
        return out.drop(*self.dropped)

    @contextmanager
    def slices(self, train: DataFrame, later: DataFrame, buckets: int | None = None) -> Iterator[DataFrame]:
        """Training rows and later rows with all features and `slice`; the past of the training rows flows on.

        No later row may be as early as the last training row. Gives the rows of `fit_transform` and of
        `transform` with the training rows as history. The frame reads tables that are deleted on leaving.
        """
        with BucketedTables(train.sparkSession, ID, buckets) as tables:
            marked = train.withColumn(SLICE, F.lit("train")).unionByName(later.withColumn(SLICE, F.lit("later")), allowMissingColumns=True)
            # Where neither the thinning nor a generator looks at the V block it stays where it is: the reader's
            # selection then decides whether it is read at all.
            apart = not self.thin_columns and all(getattr(part, "narrow", False) for _, part in self.parts)
            block = numbered(marked.columns) if apart else []
            source, columns = marked, [c for c in marked.columns if c not in block]
            rows = tables.write(marked.select(*columns), "transactions")
            train, later = (rows.where(F.col(SLICE) == s).drop(SLICE) for s in ("train", "later"))
            span = rows.agg(F.max(F.when(F.col(SLICE) == "train", F.col(V.TIME))).alias("last"), F.min(F.when(F.col(SLICE) == "later", F.col(V.TIME))).alias("first")).first()
            if span["first"] is not None and span["last"] is not None and span["first"] <= span["last"]:
                raise ValueError("a later row lies before the last training row")
            jobs = []
            for name, part in self.parts:
                if hasattr(part, "add"):
                    jobs.append(partial(self._inline, name, part, train))
                elif not hasattr(part, "family"):
                    jobs.append(partial(self._tier, tables, name, part, train, later))
            past = [part.family for _, part in self.parts if hasattr(part, "family")]
            if past:
                jobs.append(partial(self._past, tables, rows.drop(SLICE), past, span["last"]))
            if "behaviour" in past:
                jobs.append(partial(self._habits, tables, rows.drop(SLICE)))
            if "decay" in past:
                jobs.append(partial(self._frozen, tables, train, later))
            jobs.append(partial(self._thin, train))
            self.features = []
            # The tiers are jobs of their own, so the cluster works on several of them at once.
            with ThreadPoolExecutor(TIERS_AT_ONCE) as pool:
                made = [done.result() for done in [pool.submit(inheritable_thread_target(job)) for job in jobs]]
            wide = tables.joined(rows, [table for table in made if table is not None])
            frozen = [c for c in wide.columns if c.startswith(LATER)]
            wide = wide.withColumns({c[len(LATER):]: F.when(F.col(SLICE) == "later", F.col(f"`{c}`")).otherwise(F.col(f"`{c[len(LATER):]}`")) for c in frozen}).drop(*frozen)
            for _, part in self.parts:
                wide = part.add(wide) if hasattr(part, "add") else wide
            if block:
                wide = wide.join(source.select(ID, *block), ID, "left")
            order = {name: k for k, (name, _) in enumerate(self.parts)}
            self.features.sort(key=lambda f: order[f[0]])
            yield wide.drop(*self.dropped)

    def _learnt(self, name: str, part: FeatureGenerator, types: list[tuple[str, str]]) -> None:
        self.features += [(name, c, t, part.rationale) for c, t in types if c != ID]

    def _inline(self, name: str, part: FeatureGenerator, train: DataFrame) -> None:
        """Features of the row alone need no table."""
        part.fit(train)
        self._learnt(name, part, part.own(train).dtypes)

    def _tier(self, tables: BucketedTables, name: str, part: FeatureGenerator, train: DataFrame, later: DataFrame) -> DataFrame:
        part.fit(train)
        own = part.own(train)
        self._learnt(name, part, own.dtypes)
        return tables.write(own.unionByName(part.later(later, train), allowMissingColumns=True), name)

    def _past(self, tables: BucketedTables, rows: DataFrame, families: list[str], last: int | None) -> DataFrame:
        """All past features but the flags, in one table."""
        table = tables.write(P.past_features(rows, families, last), "past")
        types = dict(table.dtypes)
        for family, columns in P.family_columns(families).items():
            name, part = self._of_family(family)
            self._learnt(name, part, [(c, types[c]) for c in columns])
        return table

    def _habits(self, tables: BucketedTables, rows: DataFrame) -> DataFrame:
        table = tables.write(V.address_change(rows).join(V.device_change(rows), ID), "habits")
        self._learnt(*self._of_family("behaviour"), table.dtypes)
        return table

    def _frozen(self, tables: BucketedTables, train: DataFrame, later: DataFrame) -> DataFrame:
        """What later rows read from the state that training ended with, in columns named `later__...`."""
        _, part = self._of_family("decay")
        part.fit(train)
        found = part.later(later, None)
        return tables.write(found.select(ID, *[F.col(f"`{c}`").alias(LATER + c) for c in found.columns if c != ID]), "decay")

    def _of_family(self, family: str) -> tuple[str, FeatureGenerator]:
        return next((name, part) for name, part in self.parts if getattr(part, "family", None) == family)

    def _thin(self, train: DataFrame) -> None:
        if self.thin_columns and numbered(train.columns):
            self.groups = R.prune_correlated(train, "isFraud")
            self.dropped = [d["column"] for g in self.groups for d in g.dropped]

    def transform(self, rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Features of later rows. Without `history` past features see the slice alone; with it, the
        training rows' past flows on."""
        return self._join(rows, [part.later(rows, history) for _, part in self.parts]).drop(*self.dropped)

    def families(self, raw: list[str]) -> dict[str, str]:
        """Family of every feature and raw column."""
        return L.feature_families([(g, f) for g, f, *_ in self.features], raw)

    def manifest(self, spark) -> DataFrame:
        return spark.createDataFrame(self.features, "generator string, feature string, dtype string, rationale string")

    def manifest_json(self) -> str:
        return json.dumps([{"generator": g, "feature": f, "dtype": t, "rationale": r} for g, f, t, r in self.features], sort_keys=True)

    def save(self, spark, path: str) -> None:
        """Learned tables as Parquet, learned numbers and the manifest as JSON."""
        numbers = {"seed": config.SEED, "dropped": self.dropped}
        for name, part in self.parts:
            if isinstance(part, Amount):
                numbers["amount_edges"] = part.edges
            elif isinstance(part, Missing):
                numbers["missing_columns"] = part.columns
            elif isinstance(part, Encoding):
                numbers["encoded"] = list(part.columns)
                part.prior.write.parquet(f"{path}/{name}/prior")
                for c, table in part.tables.items():
                    table.write.parquet(f"{path}/{name}/{c}")
            elif isinstance(part, Decay):
                part.state.write.parquet(f"{path}/{name}/state")
        spark.createDataFrame([(json.dumps(numbers, sort_keys=True), self.manifest_json())], "learned string, manifest string").coalesce(1).write.json(f"{path}/manifest")

    def load_tables(self, spark, path: str) -> FeatureChain:
        """Point fitted tables at their stored copies, so later rows do not recompute the training pass."""
        learned = json.loads(spark.read.json(f"{path}/manifest").first()["learned"])
        self.dropped = learned["dropped"]
        for name, part in self.parts:
            if isinstance(part, Amount):
                part.edges = learned["amount_edges"]
            elif isinstance(part, Missing):
                part.columns = learned["missing_columns"]
            elif isinstance(part, Encoding):
                part.columns = tuple(learned["encoded"])
                part.prior = spark.read.parquet(f"{path}/{name}/prior")
                part.tables = {c: spark.read.parquet(f"{path}/{name}/{c}") for c in part.columns}
            elif isinstance(part, Decay):
                part.state = spark.read.parquet(f"{path}/{name}/state")
        return self
