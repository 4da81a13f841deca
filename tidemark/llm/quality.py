"""Quality rules with adaptive thresholds (operator 1), in DataFrame functions only.

Every text is measured once. Fixed base rules come first; for documents that pass them, shares of
symbols, capitals, repeated lines and repeated words and the mean word length go into quantile sketches
per language and source. A sketch is a histogram over log-linear bins (exact below 128, then seven
significant bits, so quantiles are off by less than 1 %). Such sketches merge by adding counts: the
language's sketch is the sum of its sources' and the corpus sketch the sum of all. Each group's upper
(for word length also lower) limit lies `REACH` distances beyond its quartiles. The distance is the group's
interquartile one, or what a single further occurrence (a symbol, a repeated line, a repeated stretch) adds in the
group's median document where that is more: measures that are 0 in most documents have no spread of their own,
and what they can resolve depends on how long the group's documents are, which sketches of the sizes tell. A
group's limits are weighted against its language's, and those against the corpus's, as `documents` to `SHRINK`.
Documents meet the limits of their group in a join and are kept if they lie within all of them.

Texts are measured in one pass and only the measures, or the rows the caller wants, are written; the
sketches hold at most a few thousand bins per group whatever its size, so a hot source is no burden.

Defined cases: null text has no words, and fails the base rules as empty text does; null languages and
sources are groups of their own; repeated rows count and are judged each; an empty table gives no rows; a very long text is
measured whole; a value on a limit is kept.
An input column whose name is one of the result's new columns is replaced; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_side, unpacked
from tidemark.session import cut_lineage

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
REACH = 5  # distances beyond the quartile
#: Per measure: the least count that shows in it, and the size that its share (of 10,000) is taken of; word length is in 1/100 characters.
MEASURES = {"symbols": (1, "word_chars"), "capitals": (1, "word_chars"), "dup_lines": (1, "n_lines"), "repeats": (2 * WINDOW, "n_words"), "word_length": (None, None)}
SIZES = ["word_chars", "n_lines", "n_words"]
LOW = {"word_length"}  # measures that also have a lower limit
SHRINK = 10  # documents that the level above counts for
EXACT_BITS = 7
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur at least twice among `words`; linear but for one sort of such texts' windows."""
    windows = F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, k, h: F.coalesce(F.get(s, k)["h"] == h, F.lit(False))
        twice = _let(ordered, lambda s: F.filter(s, lambda x, k: same(s, k - 1, x["h"]) | same(s, k + 1, x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def measured(df: DataFrame, text: str, *carried: Column) -> DataFrame:
    """`carried`, the base counts, `base_failed`, and the measures the sketches are made of."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    word = r"[^\x20\x09-\x0D]+"
    first = df.select(*carried, body.alias("__text"), F.regexp_extract_all(body, F.lit(f"({word})"), F.lit(1)).alias("__words"),
                      F.filter(F.split(body, "\n"), lambda line: line.rlike(word)).alias("__lines"))
    names = [c for c in first.columns if not c.startswith("__")]
    counted = first.select(
        *names, F.size("__words").cast("long").alias("n_words"), F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("__capitals"), F.size("__lines").cast("long").alias("n_lines"))
    share = lambda part, whole: F.expr(f"{part} * 10000 DIV greatest({whole}, 1)")
    return counted.select(
        *names, *BASE, "n_lines", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"), share("__capitals", "word_chars").alias("capitals"), share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"), F.expr("word_chars * 100 DIV greatest(n_words, 1)").alias("word_length"))


def _bin(value: str) -> Column:
    """The lower edge of the value's bin."""
    drop = f"greatest(length(bin({value})) - {EXACT_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {drop}), {drop})")


def sketches(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Bins and counts of every measure and size per group, over documents that pass the base rules."""
    long = measures.where("NOT base_failed").select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _bin(m).alias("bin")) for m in [*MEASURES, *SIZES]])).alias("x"))
    return long.groupBy(*keys, "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def limits(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, and lower and upper limits of every measure, per group of `keys`; sketches of finer groups are merged first."""
    merged = bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)})
    q = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * p, F.col("bin"))).alias(f"q{p}") for p in (1, 2, 3)]
    quartiles = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *q)
    at = lambda m, p: F.max(F.when(F.col("measure") == m, F.col(f"q{p}")))
    wide = quartiles.groupBy(*keys).agg(F.max("total").alias("documents"), *[at(m, p).alias(f"{m}_{p}") for m in MEASURES for p in (1, 3)], *[at(z, 2).alias(z) for z in SIZES])
    made = []
    for m, (least, size) in MEASURES.items():
        step = f"{least * 10000} DIV greatest({size}, 1)" if size else "1"
        made.append(F.expr(f"{m}_3 + {REACH} * greatest({m}_3 - {m}_1, {step})").alias(f"{m}_hi"))
        if m in LOW:
            made.append(F.expr(f"greatest({m}_1 - {REACH} * greatest({m}_3 - {m}_1, {step}), 0)").alias(f"{m}_lo"))
    return wide.select(*keys, "documents", *made)


def group_limits(bins: DataFrame) -> DataFrame:
    """Limits in force for every (language, source) of the sketches, weighted against those of the levels above."""
    own, mid, top = limits(bins, ["lang_key", "source_key"]), limits(bins, ["lang_key"]), limits(bins, [])
    names = [c for c in own.columns if c not in ("lang_key", "source_key", "documents")]
    weighted = lambda n, part, above: f"({n} * {part} + {SHRINK} * {above}) DIV ({n} + {SHRINK})"
    mid = mid.alias("b").join(F.broadcast(top.alias("c"))).select("b.lang_key", *[F.expr(weighted("b.documents", f"b.{n}", f"c.{n}")).alias(n) for n in names])  # the corpus has one row
    joined = own.alias("a").join(mid.alias("b"), F.col("a.lang_key").eqNullSafe(F.col("b.lang_key")), "left")
    return joined.select("a.lang_key", "a.source_key", *[F.expr(weighted("a.documents", f"a.{n}", f"b.{n}")).alias(n) for n in names])


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all by default), the base counts, `base_failed`, `kept`, and the measures."""
    added = {*BASE, "base_failed", "kept", *MEASURES}
    names = [c for c in (keep or df.columns) if c.lower() not in added]
    carried = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    stored = cut_lineage(measured(df, text, carried, F.col(f"`{lang}`").cast("string").alias("lang_key"), F.col(f"`{source}`").cast("string").alias("source_key")), "llm-measures")
    bins = cut_lineage(sketches(stored, ["lang_key", "source_key"]), "llm-sketches")
    table, seen = cut_lineage(group_limits(bins), "llm-limits", n=F.count(F.lit(1)))
    t = small_side(table, seen["n"]).alias("t")
    joined = stored.join(t, stored["lang_key"].eqNullSafe(F.col("t.lang_key")) & stored["source_key"].eqNullSafe(F.col("t.source_key")), "left")
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(m) <= F.col(f"t.{m}_hi"))
        if m in LOW:
            within = within & (F.col(m) >= F.col(f"t.{m}_lo"))
    verdict = ~F.col("base_failed") & F.coalesce(within, F.lit(False))  # a group without limits has no document that passes the base rules
    return joined.select(*unpacked(joined, names), *BASE, "base_failed", verdict.alias("kept"), *MEASURES)


def filtered(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `df` that the rules keep, with its columns."""
    spare = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    return judge(spare, keep=["whole"]).where("kept").select(*[F.col(f"whole.`{c}`").alias(c) for c in df.columns])


_W = r"'[^\x20\x09-\x0D]+'"
_BIN = "(({m} >> greatest(length(bin({m})) - 7, 0)) << greatest(length(bin({m})) - 7, 0))"
_KINDS = ", ".join(f"('{m}', {str(m in LOW).lower()}, {least or 'NULL'}, {repr(size) if size else 'NULL'})" for m, (least, size) in MEASURES.items())
_ALL = [*MEASURES, *SIZES]
MEASURES_SQL = rf"""
base AS (
  SELECT row_number() OVER () AS r, d.*, coalesce(d.text, '') AS body FROM documents d),
split AS (
  SELECT r, regexp_extract_all(body, {_W}) AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, {_W})) AS l, body FROM base),
places AS (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW}),
windows AS (SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM places),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
counts AS (
  SELECT s.r, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, len(regexp_extract_all(body, '\p{{Lu}}')) AS cap, len(l) AS n_lines
  FROM split s LEFT JOIN again a USING (r)),
measures AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols * 10000 // greatest(word_chars, 1) AS symbols, cap * 10000 // greatest(word_chars, 1) AS capitals, n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_lines,
    n_repeat_words * 10000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM counts JOIN (SELECT r AS r2, * EXCLUDE (r) FROM base) ON r = r2),
kinds(measure, low, least, size) AS (VALUES {_KINDS}),
seen(measure) AS (VALUES {', '.join(f"('{m}')" for m in _ALL)}),
bins AS (
  SELECT lang, source, measure, CASE measure {' '.join(f"WHEN '{m}' THEN {_BIN.format(m=m)}" for m in _ALL)} END AS bin
  FROM measures, seen WHERE NOT base_failed),
levels AS (SELECT 0 AS lv, lang, source, * EXCLUDE (lang, source) FROM bins UNION ALL SELECT 1, lang, NULL, * EXCLUDE (lang, source) FROM bins UNION ALL SELECT 2, NULL, NULL, * EXCLUDE (lang, source) FROM bins),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lv, lang, source, measure ORDER BY bin) AS k, count(*) OVER (PARTITION BY lv, lang, source, measure) AS n FROM levels),
quartiles AS (
  SELECT lv, lang, source, measure, max(n) AS n, min(bin) FILTER (4 * k >= n) AS q1, min(bin) FILTER (4 * k >= 2 * n) AS q2, min(bin) FILTER (4 * k >= 3 * n) AS q3
  FROM ranked GROUP BY ALL),
fences AS (
  SELECT q.lv, q.lang, q.source, q.measure, q.n, {REACH} * greatest(q.q3 - q.q1, coalesce(k.least * 10000 // greatest(z.q2, 1), 1)) AS reach, greatest(q.q1 - reach, 0) AS lo, q.q3 + reach AS hi
  FROM quartiles q JOIN kinds k USING (measure) LEFT JOIN quartiles z ON z.measure = k.size AND z.lv = q.lv AND z.lang IS NOT DISTINCT FROM q.lang AND z.source IS NOT DISTINCT FROM q.source),
of_lang AS (
  SELECT f.lang, f.measure, (f.n * f.lo + {SHRINK} * c.lo) // (f.n + {SHRINK}) AS lo, (f.n * f.hi + {SHRINK} * c.hi) // (f.n + {SHRINK}) AS hi
  FROM fences f JOIN fences c ON f.lv = 1 AND c.lv = 2 AND c.measure = f.measure),
in_force AS (
  SELECT f.lang, f.source, f.measure, (f.n * f.lo + {SHRINK} * c.lo) // (f.n + {SHRINK}) AS lo, (f.n * f.hi + {SHRINK} * c.hi) // (f.n + {SHRINK}) AS hi
  FROM fences f JOIN of_lang c ON f.lv = 0 AND c.measure = f.measure AND c.lang IS NOT DISTINCT FROM f.lang),
judged AS (
  SELECT m.r, bool_and(v <= f.hi AND (NOT low OR v >= f.lo)) AS within
  FROM (SELECT r, lang, source, k.measure, k.low, CASE k.measure {' '.join(f"WHEN '{m}' THEN {m}" for m in MEASURES)} END AS v FROM measures, kinds k WHERE NOT base_failed) m
  JOIN in_force f ON f.measure = m.measure AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
  GROUP BY m.r),
rules AS (SELECT m.*, NOT base_failed AND coalesce(within, false) AS kept FROM measures m LEFT JOIN judged USING (r))
"""

ORACLE = f"WITH {MEASURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM rules"
