"""Main text, resharding and language identification."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import classifier, langid, mainblocks, neardup, packing, quality, sharding
from tidemark.llm.chunks import Texts
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ARTICLE = "This is a first paragraph of the article, and it has a number of words in it."


def test_cuts_are_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        content, rest = [2 * rng.random() for _ in range(n)], [2 * rng.random() for _ in range(n)]
        edges = {(a, b): 1.5 * rng.random() for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(labels):
            return sum(content[k] if x else rest[k] for k, x in enumerate(labels)) + sum(p for (a, b), p in edges.items() if labels[a] != labels[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(mainblocks.cheapest_labels(content, rest, edges)) - best) < 1e-9


def test_long_chains_are_cut():
    rng = random.Random(3)
    n = 4000
    lean = [rng.uniform(-1, 1) for _ in range(n)]
    labels = mainblocks.cheapest_labels([max(-x, 0) for x in lean], [max(x, 0) for x in lean], {(k, k + 1): 0.8 for k in range(n - 1)})
    keep, drop = 0.0, 0.0  # of the best labelling that ends with this label
    for x in lean:
        keep, drop = min(keep, drop + 0.8) + max(-x, 0), min(drop, keep + 0.8) + max(x, 0)
    first = sum(max(-x, 0) if on else max(x, 0) for x, on in zip(lean, labels)) + 0.8 * sum(a != b for a, b in zip(labels, labels[1:]))
    assert abs(first - min(keep, drop)) < 1e-6


@pytest.mark.parametrize("rest", [
    "<nav><ul><li><a href='/a'>Home</a></li><li>News</li></ul></nav>", "<header class='top'><h1>The site</h1><p>A slogan, said in words.</p></header>",
    "<div id=\"sidebar\"><p>Some more text that is long enough to look like content, really.</p></div>", "<div class='cookie-notice'><p>We use cookies, as everybody does, for your own good.</p></div>",
    "<div class=ad>Buy this now, it is the best there is, they all say.</div>", "<form action=/><label>Name</label><input><p>Sign up for the news of the week, please.</p></form>",
    "<aside><p>An aside of quite some words, which ends with a full stop.</p></aside>", "<section class='comments'><article class='comment'><p>First! A great article, thanks for writing it.</p></article></section>",
    "<div role=navigation>Up and down</div>", "<footer><p>Made by us in the year of 2020, with care and attention.</p></footer>", "<script>var a = '<p>not text</p>';</script>", "<style>p{margin:0}</style>", "<!-- <p>no</p> -->",
    "<noscript><p>Please enable scripts to see all of this page.</p></noscript>",
])
def test_rest_of_a_page_goes(rest):
    for page in (f"<html><head><title>T</title></head><body>{rest}<article><h1>Title</h1><p>{ARTICLE}</p></article></body></html>",
                 f"<html><body><article><h1>Title</h1><p>{ARTICLE}</p></article>{rest}</body></html>", *([f"<body><article><h1>Title</h1><p>{ARTICLE}</p>{rest}</article>"] if "<header" not in rest else [])):  # an article's own header belongs to it
        assert mainblocks.main_text(page) == f"Title\n{ARTICLE}"


def test_pages_without_semantic_tags():
    page = f"<body><div><a href=x>Home</a> <a href=y>About</a></div><div><p>{ARTICLE}</p><p>Short.</p><p>{ARTICLE}</p></div><div>© 2020 Us. All rights reserved.</div>"
    assert mainblocks.main_text(page) == f"{ARTICLE}\nShort.\n{ARTICLE}"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p", ""), ("<article><p>a &lt;b&gt;&amp;&eacute;&#8364; &nosuch;<br>\n\t c</article>", "a <b>&é€ &nosuch; c"), ("<article><p>one<p>two<b>three</b></article>", "one\ntwothree"),
    ("<article><p title=\"a > b\">x y</p><ul><li>i<li>j</ul></article>", "x y\ni\nj"), ("<article><p>open <script>var x", "open"), ("<article>" + "<div>" * 3000 + "deep text", "deep text"),
])
def test_odd_pages(page, text):
    assert mainblocks.main_text(page) == text


@pytest.mark.parametrize("before", [
    "<svg width='1' />", "<svg/>", "<math/>", "<svg><svg /><text>no</text></svg>", "<object><object>no</object>no</object>", "<video src=a>", "<object data=a>", "<noscript>", "<canvas>", "<select>", "<template>", "<iframe src=a>", "<audio>",
    "<svg viewBox='0 0 1 1'>", "<video src=a><video src=b>no</video>", "<video><script>'<video>'</script>no</video>", "<!-- <svg> --><svg title='</svg>'>no</svg>",
])
def test_raw_elements_drop_nothing_else(before):
    rest = f"<p>{ARTICLE}</p><p>{ARTICLE} <svg width=5/>no</svg>More.</p>"
    text = f"{ARTICLE}\n{ARTICLE} More."
    assert mainblocks.main_text(f"<body><article>{before}{rest}</article>") == text
    assert mainblocks.main_text(f"<article>{rest}{before}{rest}</article>") == f"{text}\n{text}"


@pytest.mark.parametrize("head", ["<head><title>T</title><meta charset=utf-8>", "<head><script>var a</script><link rel=x href=y>", "<html><head><style>p{}</style></head>", "<head><title>T</title></head><body class=a>", "<head><noscript><p>no</p></noscript>"])
def test_head_ends_where_it_must(head):
    assert mainblocks.main_text(f"{head}<article><p>{ARTICLE}</p></article>") == ARTICLE
    assert mainblocks.main_text(f"{head}\n{ARTICLE}") == ARTICLE


def test_text_of_math_is_text():
    page = f"<article><p>{ARTICLE} So <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>. {ARTICLE}</p><p>{ARTICLE} <math><mspace/><mn>1</mn></p><p>{ARTICLE}</p></article>"
    assert mainblocks.main_text(page) == f"{ARTICLE} So E = m c 2. {ARTICLE}\n{ARTICLE} 1\n{ARTICLE}"


def test_many_endless_tags_take_one_look():
    page = "<article>" + "<noscript><svg>a " * 40_000 + "</article>"
    assert mainblocks.main_text(page).split() == ["a"] * 40_000


def test_extract_frames(spark):
    rows = [(1, "u", None, "x", 1), (None, None, f"<article><p>{ARTICLE}</p></article>", None, None), (3, "u", "", "x", 3), (3, "u", "", "x", 3), (4, "u", f"<article>{'<p>' + ARTICLE + '</p>' :s}</article>" + "<div>x</div>" * 20_000, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row int")
    out = mainblocks.extract(df)
    assert out.columns == ["page_id", "url", "row", "text", "n_chars"] and out.count() == 5
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect())[0] == (0, len(ARTICLE))
    assert mainblocks.extract(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_articles_of_the_table(spark):
    """Every page of the table holds one article: its blocks, cut out by other means, are the result."""
    import html
    import re

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    got = QUERIES["op3_main_text"](spark, SF).toPandas().set_index("page_id")
    for k, page in pages.items():
        inner = re.sub(r"</?(p|h1)>", "\n", page[page.index("<article>") + 9: page.index("</article>")])
        lines = [" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", " ", inner).split("\n")]
        assert got.text[k] == "\n".join(x for x in lines if x)


def test_transfers_move_the_fewest_bytes():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(0, 60) for _ in range(rng.randint(1, 6))]
        capacities = sharding.even_capacities(sum(sizes) + rng.randint(0, 9), rng.randint(1, 6))
        flow = sharding.cheapest_transfers(sizes, capacities)
        for i, size in enumerate(sizes):
            assert sum(v for (a, _), v in flow.items() if a == i) == size
        for j, capacity in enumerate(capacities):
            assert sum(v for (_, b), v in flow.items() if b == j) <= capacity
        kept = sum(min(s, capacities[i]) for i, s in enumerate(sizes) if i < len(capacities))
        assert sum(v for (a, b), v in flow.items() if a != b) == sum(sizes) - kept
    with pytest.raises(ValueError):
        sharding.cheapest_transfers([5], [4])


def check_shards(got: pd.DataFrame, shards: int, biggest: int) -> None:
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = got.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 4 * biggest


def test_resharding_frames(spark, tmp_path):
    texts = [None, "", "é" * 3, "x" * 400, *["copy of a text"] * 300, *["y" * (k % 37) for k in range(500)]]
    df = spark.createDataFrame([(k if k % 9 else None, t, 1, "s") for k, t in enumerate(texts)], "doc_id long, text string, shard int, slot string").repartition(5)
    old = F.pmod(F.xxhash64("text"), F.lit(7))
    out = sharding.reshard(df, old, str(tmp_path / "a"))
    assert out.select("row.*").schema == df.schema
    got = out.toPandas()
    assert len(got) == len(texts) and got["size"].sum() == sum(len((t or "").encode()) + 1 for t in texts)
    check_shards(got, 16, 401)
    assert sharding.reshard(df.limit(0), old, str(tmp_path / "b")).count() == 0


def test_only_affected_shards_are_written(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * 9) for k in range(400)], "doc_id long, text string")
    old = (F.col("doc_id") % 4).cast("int")
    path = str(tmp_path / "c")
    out = sharding.reshard(df, old, path, shards=4, capacities=[1000, 1000, 700, 1300])
    assert sorted(d for d in os.listdir(path) if d.startswith("shard")) == ["shard=2", "shard=3"]
    got = out.toPandas()
    assert got.groupby("shard").size().to_dict() == {0: 100, 1: 100, 2: 70, 3: 130}
    assert (got.old != got.shard).sum() == 30
    check_shards(got, 4, 1000)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_shards_of_the_table(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    got = QUERIES["op8_flow_resharding"](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(docs.index)
    raw = {k: (t or "").encode() for k, t in docs.items()}
    assert all(r.size == len(raw[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(raw[r.doc_id]) for r in got.itertuples(index=False) for r in [r._asdict() and type("R", (), r._asdict())])
    check_shards(got, 16, int(got["size"].max()))


def test_windows_cover_texts():
    texts = ["a" * 300, "", None, "É" * 64, "x"]
    x, before = langid.windows(Texts(pa.array(texts)))
    for k, t in enumerate(texts):
        own = x[before[k]: before[k + 1]].ravel()
        assert bytes(own[own != langid.PAD].astype(np.uint8)) == (t or "").encode()


def test_gradients_learn():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, (600, langid.WINDOW)).astype(np.int16)
    y = rng.integers(0, 2, 600)
    for k in np.flatnonzero(y):
        x[k, 40:44] = np.frombuffer(b"zqzq", np.uint8)
    net = langid.train(x, y, ["no", "yes"])
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.97
    np.testing.assert_allclose(net.probabilities(x).sum(1), 1, rtol=1e-5)


def test_language_cases(spark):
    english, german = "the cat and the dog of the house ", "der hund und die katze im haus "
    rows = [(k, (english if k % 2 else german) * (2 + k % 5), "en" if k % 2 else "de", "p", 0.1) for k in range(80)]
    rows += [(None, english, "en", None, None), (200, None, "en", "p", 0.1), (201, "12345 ...", "de", "p", 0.1), (202, "", None, "p", 0.1), (203, german * 4000, None, "p", 0.1), (203, german * 4000, None, "p", 0.1), (204, "日本", None, "p", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    net = langid.fit(df, F.col("doc_id") < 60)
    got = langid.predict(df, net)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.count() == len(rows)
    found = {r.doc_id: r for r in got.collect()}
    assert all(found[k].lang_pred == ("en" if k % 2 else "de") for k in range(80)) and found[203].lang_pred == "de"
    assert {(found[k].lang_pred, found[k].score) for k in (200, 201, 202)} == {("und", 0.0)} and found[204].lang_pred in ("en", "de")
    assert langid.predict(df.limit(0), net).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit(df, F.lit(False))).collect()} == {"und"}
    one = langid.predict(df, langid.fit(df.where("lang = 'en'"), F.lit(True))).where("doc_id = 1").first()
    assert one.lang_pred == "en" and one.score == 1.0


def test_every_language_is_learned(spark, monkeypatch):
    """Languages beyond the 200 with the most windows, and a sample that all share."""
    rows = [(1000 * k + j, f"{chr(97 + k // 26)}{chr(97 + k % 26)} " * (600 if k < 220 else 90), f"l{k}") for k in range(230) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(langid, "train", lambda x, y, languages: seen.update(x=x, y=y, languages=languages))
    langid.fit(df, F.lit(True))
    assert seen["languages"] == sorted(f"l{k}" for k in range(230)) and set(seen["y"].tolist()) == set(range(230))
    monkeypatch.setattr(langid, "SAMPLE_IN_ALL", 500)
    langid.fit(df, F.lit(True))
    assert np.bincount(seen["y"]).tolist() == [2] * 230 and len(seen["x"]) == 460


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_languages(spark):
    got = QUERIES["op9_language_id"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_pipeline_is_its_stages(spark):
    """The rows of run() hold the documents that the operators, applied by hand, leave over; each stage works on the last one's rows."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = {r.doc_id for r in quality.judge(docs, keep=["doc_id"]).where("kept").select("doc_id").collect()}
    model = classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in classifier.score(docs, model, keep=["doc_id"]).where("predicted = 1").collect()} & rules
    one = {r.id for r in neardup.groups(docs.where(F.col("doc_id").isin(sorted(good)))).where("kept").collect()}
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert set(rows.doc_id) == one and 0 < len(one) < len(good) < len(rules)
    assert rows.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_stages_take_any_table(spark, tmp_path):
    """Stages keep the columns of documents, extra ones too, and take null rows and empty tables."""
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string"
    text = "The quick brown fox jumps over the lazy dog near the river bank while children play and older people read their books in silence."
    docs = spark.createDataFrame([(k, f"{text} {k}", "en", "s", 9, None, "r") for k in range(30)] + [(None, None, None, None, None, None, None), (7, "", "en", "s", 0, True, "x")], schema)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, sf)
            assert out.schema == given.schema
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, given, sf).count()
