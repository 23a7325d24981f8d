"""Quality rules whose thresholds follow quantile sketches of each language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.llm.common import SPACE, cut, let

#: Relative accuracy of a sketch's values.
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: A group of fewer rows takes the thresholds of its language, and a language of fewer rows those of all; where a threshold
#: follows the positive values, of so many of these.
MIN_GROUP, MIN_POSITIVE = 200, 50
#: A fence stands so many times the distance between the quartiles beyond them.
FENCE = 4
#: Most texts have no repeats: where there are some, their share is spread evenly by its logarithm, and the fence stands
#: some standard deviations above the median, of which the quartiles are 1.349 apart. Quartiles whose ratio is below
#: LEAST_RATIO count as if it were that.
APART, LEAST_RATIO = 1.349, 2.0
#: Nor is a text an outlier for up to one symbol in ten words, where its group has none at all and so no spread.
TOLERANCE = 100
#: metric: the kind of its fences. `both` and `high` follow the quartiles of all values, a number those of the values above
#: 0, so many standard deviations beyond.
METRICS = {"word_length": "both", "symbols": "high", "dup_lines": 2.5, "repeats": 3.0}


def _repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more.

    Windows are told apart by a 64-bit hash. Texts whose windows all differ are done; else a sort of (hash, position)
    brings equal windows together, and in order of position each adds the words that the one before doesn't cover.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: (F.get(s, j + 1)["h"].eqNullSafe(e["h"])) | (F.get(s, j - 1)["h"].eqNullSafe(e["h"])))
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(let(ordered, positions)))

    return F.when(n < 3, 0).otherwise(let(hashes, count)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select("doc_id", "lang", "source", text.alias("t"))
    rows = rows.select("*", F.array_remove(F.split("t", f"[{SPACE}]+"), "").alias("w"), lines.alias("l"))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        let(F.col("w"), _repeat_words).alias("n_repeat_words"),
    )


def _values() -> dict[str, Column]:
    """The metrics in whole numbers: mean word length in hundredths, the rest in thousandths."""
    part = lambda a, b, by: F.expr(f"CASE WHEN {b} = 0 THEN 0 ELSE {by} * {a} DIV {b} END")
    return {
        "word_length": part("word_chars", "n_words", 100),
        "symbols": part("n_symbols", "n_words", 1000),
        "dup_lines": part("n_dup_lines", "n_lines", 1000),
        "repeats": part("n_repeat_words", "n_words", 1000),
    }


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): sketches with buckets of equal ratio; two merge by adding up n.

    Bucket b > 0 has the values in (GAMMA ** (b - 1), GAMMA ** b], bucket 0 the value 0. Rows without words are left out.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in _values().items()])
    rows = rows.where("n_words > 0").select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.*")
    bucket = F.when(F.col("value") <= 0, 0).otherwise(F.ceil(F.log("value") / math.log(GAMMA))).cast("int")
    return rows.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, rows, q1, q3, positive, p1, p2, p3) of sketches merged to the groups named.

    rows and positive count all values and those above 0, q and p are quartiles of these.
    """
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    merged = merged.withColumn("up_to", F.sum("n").over(group.orderBy("bucket"))).withColumn("rows", F.sum("n").over(group))
    merged = merged.withColumn("zeros", F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(group))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), "bucket") / (GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("up_to") > F.floor((F.col("rows") - 1) * q), value))
    above = lambda q: F.min(F.when((F.col("bucket") > 0) & (F.col("up_to") - F.col("zeros") > F.floor((F.col("rows") - F.col("zeros") - 1) * q)), value))
    counts = [F.max("rows").alias("rows"), F.max(F.col("rows") - F.col("zeros")).alias("positive")]
    return merged.groupBy(*by, "metric").agg(*counts, at(0.25).alias("q1"), at(0.75).alias("q3"), *[above(k / 4).alias(f"p{k}") for k in (1, 2, 3)])


def _fences(kind: str | float) -> tuple[Column, Column, Column]:
    """(lower fence, upper fence, whether the group has enough values for them) from a row of quantiles()."""
    reach = FENCE * (F.col("q3") - F.col("q1"))
    if isinstance(kind, float):
        high = F.col("p2") * F.pow(F.greatest(F.col("p3") / F.col("p1"), F.lit(LEAST_RATIO)), F.lit(kind / APART))
        return F.lit(-1.0), high, F.col("positive") >= MIN_POSITIVE
    if kind == "high":
        return F.lit(-1.0), F.col("q3") + reach + TOLERANCE, F.col("rows") >= MIN_GROUP
    return F.col("q1") - reach, F.col("q3") + reach, F.col("rows") >= MIN_GROUP


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, low_METRIC..., high_METRIC...) for each language and source of the sketches.

    A null is no threshold: not even all rows together have enough positive values.
    """

    def wide(q: DataFrame, by: list[str], prefix: str) -> DataFrame:
        cells = []
        for metric, kind in METRICS.items():
            low, high, enough = _fences(kind)
            enough = F.lit(True) if not by and isinstance(kind, str) else enough  # all rows are never too few for quartiles
            cells += [F.max(F.when((F.col("metric") == metric) & enough, v)).alias(f"{prefix}{side}_{metric}") for side, v in (("low", low), ("high", high))]
        return q.groupBy(*by).agg(*cells)

    own = wide(quantiles(sketch, ["lang", "source"]), ["lang", "source"], "s_")
    lang = wide(quantiles(sketch, ["lang"]), ["lang"], "l_").withColumnRenamed("lang", "lang_")
    every = wide(quantiles(sketch, []), [], "a_")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_"))).join(F.broadcast(every))  # every is one row
    return joined.select("lang", "source", *[F.coalesce(*[f"{p}_{side}_{m}" for p in "sla"]).alias(f"{side}_{m}") for m in METRICS for side in ("low", "high")])


def filter_rules(docs: DataFrame) -> DataFrame:
    """measured() with base_failed, kept and failed_rules (the metrics beyond their thresholds), a row for each row of docs.

    A row that fails a base rule (fewer than 50 words, or more than half of them in repeated windows) is not kept; any
    other is kept unless a metric stands outside the fences of its language and source, which follow the rows that pass
    the base rules, if there are enough values for them. Null texts count as empty; a
    null language or source is a group of its own; ties with a threshold are kept; an empty table gives an empty one;
    columns beyond doc_id, text, lang, source are ignored.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = cut(measured(docs).withColumn("base_failed", base))
    limits = cut(thresholds(sketches(rows.where(~F.col("base_failed"))))).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    outside = [F.when(F.coalesce((v > F.col(f"high_{m}")) | (v < F.col(f"low_{m}")), F.lit(False)), F.lit(m)) for m, v in _values().items()]
    rows = rows.join(limits, same, "left").withColumn("failed_rules", F.array_compact(F.array(*outside)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return rows.drop("lang_", "source_")


_PARTS = {"word_length": ("word_chars", "n_words", 100), "symbols": ("n_symbols", "n_words", 1000), "dup_lines": ("n_dup_lines", "n_lines", 1000), "repeats": ("n_repeat_words", "n_words", 1000)}


def _oracle() -> str:
    values = ", ".join(f"CASE WHEN {b} = 0 THEN 0 ELSE {by} * {a} // {b} END AS {m}" for m, (a, b, by) in _PARTS.items())
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS value FROM v WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words" for m in METRICS)
    reach = f"{FENCE} * (q3 - q1)"

    def level(name: str, by: str) -> str:
        keys, comma = by, ", " if by else ""
        enough = lambda kind: f"positive >= {MIN_POSITIVE}" if isinstance(kind, float) else f"rows_ >= {MIN_GROUP}" if by else "true"
        powers = {k: f"p2 * pow(greatest(p3 / p1, {LEAST_RATIO}::DOUBLE), {k / APART!r}::DOUBLE)" for k in METRICS.values() if isinstance(k, float)}
        upper = powers | {"high": f"q3 + {reach} + {TOLERANCE}", "both": f"q3 + {reach}"}
        high = "CASE " + " ".join(f"WHEN metric = '{m}' AND {enough(kind)} THEN {upper[kind]}" for m, kind in METRICS.items()) + " END"
        low = "CASE " + " ".join(f"WHEN metric = '{m}' AND {enough(kind)} THEN {'q1 - ' + reach if kind == 'both' else -1}" for m, kind in METRICS.items()) + " END"
        above = lambda q: f"min(CASE WHEN bucket > 0 AND up_to - zeros > floor((rows_ - zeros - 1) * {q}) THEN val END)"
        return f"""
{name}m AS (SELECT {keys}{comma}metric, bucket, sum(n)::BIGINT AS n FROM k GROUP BY {keys}{comma}metric, bucket),
{name}w AS (SELECT *, sum(n) OVER (PARTITION BY {keys}{comma}metric ORDER BY bucket) AS up_to,
      sum(n) OVER (PARTITION BY {keys}{comma}metric) AS rows_,
      sum(CASE WHEN bucket = 0 THEN n ELSE 0 END) OVER (PARTITION BY {keys}{comma}metric) AS zeros,
      CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE 2 * pow({GAMMA!r}::DOUBLE, bucket) / ({GAMMA!r}::DOUBLE + 1) END AS val FROM {name}m),
{name}q AS (SELECT {keys}{comma}metric, max(rows_) AS rows_, max(rows_ - zeros) AS positive,
      min(CASE WHEN up_to > floor((rows_ - 1) * 0.25) THEN val END) AS q1, min(CASE WHEN up_to > floor((rows_ - 1) * 0.75) THEN val END) AS q3,
      {above(0.25)} AS p1, {above(0.5)} AS p2, {above(0.75)} AS p3 FROM {name}w GROUP BY {keys}{comma}metric),
{name}t AS (SELECT {keys}{comma}metric, {high} AS high, {low} AS low FROM {name}q)"""

    bad = " OR ".join(f"coalesce({m} > max(h) FILTER (WHERE metric = '{m}') OR {m} < max(lo) FILTER (WHERE metric = '{m}'), false)" for m in METRICS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, s) AS c FROM g) WHERE c > 1),
p AS (SELECT id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY id),
m AS (SELECT w.id, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (id)),
v AS (SELECT *, {values} FROM m),
u AS ({union}),
k AS (SELECT lang, source, metric, CASE WHEN value <= 0 THEN 0 ELSE ceil(ln(value) / {math.log(GAMMA)!r}::DOUBLE) END::INT AS bucket,
        count(*) AS n FROM u GROUP BY ALL),
{level("s", "lang, source")},{level("l", "lang")},{level("e", "")},
f AS (SELECT st.lang, st.source, st.metric, coalesce(st.high, lt.high, et.high) AS h, coalesce(st.low, lt.low, et.low) AS lo
      FROM st JOIN lt ON st.lang IS NOT DISTINCT FROM lt.lang AND st.metric = lt.metric JOIN et ON st.metric = et.metric),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v),
x AS (SELECT id, {bad} AS bad FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
      GROUP BY id, {", ".join(METRICS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b JOIN x USING (id)
"""


ORACLE = _oracle()
