"""Streams in several micro-batches against the batch operators."""

from __future__ import annotations

import math
import random

import pytest

from tests.test_history import SCHEMA, collected, make_rows
from tidemark.operators import velocity as V
from tidemark.streaming import rates as R
from tidemark.streaming.runner import drain, stream_of
from tidemark.streaming.stateful import DecayStream, VelocityStream


@pytest.fixture(scope="module")
def rows():
    return sorted(make_rows(160, 21, span=10 * 86400), key=lambda r: (r[1], r[0]))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def closing(rows):
    """A transaction so late that the watermark passes all others."""
    at = max(r[1] for r in rows) + 40 * 86400
    return [(-1, at, *[None] * (len(rows[0]) - 2))]


def streamed(spark, parts):
    return stream_of([frame(spark, p) for p in parts], files=2)


def test_velocity_in_batches_with_disorder(spark, rows):
    rng = random.Random(2)
    jittered = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 7000))  # out of order by less than the delay
    job = VelocityStream(spark, ["card1", "addr1"], {"1h": 3600, "24h": 86400}, delay=7200)
    late = job.run(streamed(spark, [jittered[:70], jittered[70:110], jittered[110:], closing(rows)]))
    assert collected(job.output()) == collected(V.velocity(frame(spark, rows), ["card1", "addr1"], {"1h": 3600, "24h": 86400})) and late == 0


def test_a_stream_goes_on_where_it_stopped(spark, rows, tmp_path):
    """Two runs over one growing folder; repeated transactions count once."""
    root, source = str(tmp_path / "job"), str(tmp_path / "in")
    frame(spark, rows[:80]).write.parquet(source)
    outputs = []
    for more in (rows[70:] + closing(rows), None):
        job = DecayStream(spark, ["card1", "addr1"], delay=5 * 86400, root=root)
        late = job.run(spark.readStream.schema(SCHEMA).parquet(source))
        assert late == 0
        outputs.append(collected(job.output()))
        if more:
            frame(spark, more).write.mode("append").parquet(source)
    assert 0 < len(outputs[0]) < 80
    compare_decay(outputs[1], collected(V.ewm(frame(spark, rows), ["card1", "addr1"])))
    assert all(outputs[1][i] == v for i, v in outputs[0].items())


def compare_decay(got, want):
    assert got.keys() == want.keys()
    for i in want:
        for c, v in want[i].items():
            assert math.isclose(got[i][c], v, rel_tol=1e-9, abs_tol=1e-12), (i, c)


def test_late_rows_are_counted_and_left_out(spark, rows):
    job = VelocityStream(spark, ["card1"], {"24h": 86400}, delay=1)
    again = [(1000 + r[0], *r[1:]) for r in rows[:30]]
    cut = next(k for k in range(60, 100) if rows[k][1] > rows[k - 1][1])  # no tie with the watermark
    late = job.run(streamed(spark, [rows[:50], rows[50:cut], rows[cut:] + again, closing(rows)]))
    assert late == 30 and max(r[1] for r in again) < rows[49][1]
    assert collected(job.output()) == collected(V.velocity(frame(spark, rows), ["card1"], {"24h": 86400}))


def test_rows_that_are_late_by_one_batch_meet_their_second(spark, rows):
    job = DecayStream(spark, ["card1"], delay=1)
    cut = next(k for k in range(60, 100) if rows[k][1] > rows[k - 1][1])
    known = next(r for r in reversed(rows[:cut - 20]) if r[3] == 1)
    every = rows + [(1000, *known[1:])]
    assert job.run(streamed(spark, [rows[:cut], every[cut:], closing(rows)])) == 0
    compare_decay(collected(job.output()), collected(V.ewm(frame(spark, every), ["card1"])))


def test_decay_in_batches_and_a_hot_entity(spark, rows):
    hot = [(5000 + k, 86400 + k // 3, *rows[0][2:]) for k in range(400)]
    every = sorted(rows + hot, key=lambda r: (r[1], r[0]))
    job = DecayStream(spark, ["card1", "addr1"], delay=1)
    # No cut falls inside a tie: rows tied with the watermark would be late.
    cuts = [k for k in (200, 420) if every[k][1] > every[k - 1][1]]
    parts = [every[a:b] for a, b in zip([0, *cuts], [*cuts, len(every)])]
    assert job.run(streamed(spark, [*parts, closing(every)])) == 0
    compare_decay(collected(job.output()), collected(V.ewm(frame(spark, every), ["card1", "addr1"])))


def test_repeats_across_files_are_written_once(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    cols = "request_id string, created_at timestamp"
    for i in range(2):
        spark.createDataFrame([("a", at), (f"b{i}", at + datetime.timedelta(minutes=i))], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(R.once_per_request(stream), "once")
    assert sorted(r["request_id"] for r in out.collect()) == ["a", "b0", "b1"]


def test_sustained_needs_every_evaluation(spark):
    rows = [(60 * i, 60 * i + 300, i not in (4, 12)) for i in range(14)]
    df = spark.createDataFrame(rows, "window_start long, window_end long, breach boolean")
    got = sorted((r["window_start"]) // 60 for r in R.sustained(df, 180, 60).collect())
    assert got == [3, 8, 9, 10, 11]


class _Kept:
    """A processor's handle with its one state in memory."""

    def __init__(self):
        self.values, self.timers, self.single = [], [], False

    def getListState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        self.single = True
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def appendValue(self, value):  # noqa: N802
        self.values.append(value)

    def get(self):
        return self.values[0] if self.single else iter(self.values)

    def exists(self):
        return bool(self.values)

    def update(self, value):
        self.values = [value]


def _asking(rows):
    import pandas as pd

    return iter([pd.DataFrame([("card1", v, t, n, float(n), [i]) for i, (v, t, n) in enumerate(rows)], columns=["entity", "value", "ts", "n", "f", "ids"])])


def test_one_call_serves_many_entity_values():
    from tidemark.streaming.stateful import _Decay, _Window

    window, decay = _Window([10, 100]), _Decay([3600.0])
    window.init(kept := _Kept())
    decay.init(_Kept())
    list(window.handleInputRows((0, 0), _asking([("a", 1, 1), ("b", 2, 5), ("a", 3, 2)]), None))
    (got,) = window.handleInputRows((0, 0), _asking([("b", 20, 1), ("a", 12, 1)]), None)
    assert {r.value: (r.n0, r.n1) for r in got.itertuples()} == {"b": (0, 5), "a": (2, 3)} and kept.timers == [100_000]
    list(decay.handleInputRows((0,), _asking([("a", 1, 1), ("b", 2, 5)]), None))
    (got,) = decay.handleInputRows((0,), _asking([("b", 3, 1), ("a", 3, 1)]), None)
    assert {r.value: round(r.v[0], 9) for r in got.itertuples()} == {"a": round(math.exp(-2), 9), "b": round(5 * math.exp(-1), 9)}
