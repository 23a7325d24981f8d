"""Licence scans: ordered signature rules behind a keyword filter, with overlaps resolved by priority and containment."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import ascii_lower, let
from vantor.llm.license_rules import CONFIDENCE, GATES, RULES

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases whose every place counts, and the labels they stand for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.6
MARK = "\x01"  # a separator, so no word has it


def normalised(text: Column) -> Column:
    """The words of the text in lower case (A-Z only) with one space between."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _starts(padded: Column, pattern: Column) -> Column:
    """The number of the first word of each match, in order: matches are marked, words counted."""
    marked = F.split(F.trim(F.regexp_replace(padded, pattern, F.lit(f"{MARK}$0"))), " ")
    places = F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i))
    return F.array_compact(places)


def _phrase_places(padded: Column, phrase: str) -> Column:
    pattern, none = F.lit(f"(?<= ){phrase}(?= )"), F.array().cast("array<int>")
    return let(padded, lambda t: F.when(F.contains(t, F.lit(f" {phrase} ")), _starts(t, pattern)).otherwise(none))


def _detections(padded: Column) -> Column:
    """array<struct<first, last, priority, label>>: all matches of all rules whose keyword the text has."""
    rules = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("key"), F.lit(f"(?<= )(?:{x})(?= )").alias("pattern")) for a, p, k, x in RULES])
    live = F.filter(rules, lambda r: F.contains(padded, r["key"]))

    def of(r: Column) -> Column:
        found = F.regexp_extract_all(padded, r["pattern"], F.lit(0))
        span = lambda at, m: F.struct(at.alias("first"), (at + _spaces(m)).alias("last"), r["priority"].alias("priority"), r["label"].alias("label"))
        return F.zip_with(_starts(padded, r["pattern"]), found, span)

    return F.flatten(F.transform(live, of))


def _resolved(found: Column) -> Column:
    """The detections that no other of the same or a higher priority contains; of equal spans the first by label stays.

    In order of start, longest and of highest priority first, one is contained if some earlier one of at least its
    priority reaches as far: a running largest end for each priority tells.
    """
    ordered = F.transform(F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("a"), (-d["last"]).alias("b"), (-d["priority"]).alias("c"), d["label"].alias("label")))), lambda d: F.struct(d["a"].alias("first"), (-d["b"]).alias("last"), (-d["c"]).alias("priority"), d["label"].alias("label")))
    kind = "array<struct<first:int,last:int,priority:int,label:string>>"
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in CONFIDENCE], F.array().cast(kind).alias("kept"))

    def step(a: Column, d: Column) -> Column:
        beaten = reduce(or_, [(d["priority"] <= p) & (a[f"e{p}"] >= d["last"]) for p in CONFIDENCE])
        ends = [F.when(d["priority"] == p, F.greatest(a[f"e{p}"], d["last"])).otherwise(a[f"e{p}"]).alias(f"e{p}") for p in CONFIDENCE]
        return F.struct(*ends, F.when(beaten, a["kept"]).otherwise(F.array_append(a["kept"], d)).alias("kept"))

    return F.aggregate(ordered, start, step, lambda a: a["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for each row of docs.

    detections: (first, last, priority, label) of the rules' matches that stand, in words from 0. All is done within
    the row: nothing is shuffled. Null and empty texts have no words, places or labels; repeated rows are answered one
    by one; an empty table gives an empty one; columns beyond doc_id and text are ignored.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    words = F.when(F.col("body") == "", 0).otherwise(_spaces(F.col("body")) + 1)
    rows = rows.select("doc_id", words.cast("long").alias("n_words"), F.concat(F.lit(" "), F.col("body"), F.lit(" ")).alias("padded"))
    padded = F.col("padded")
    gated = reduce(or_, [F.contains(padded, F.lit(g)) for g in GATES])
    none = F.array().cast("array<struct<first:int,last:int,priority:int,label:string>>")
    found = F.when(gated, let(let(padded, _detections), _resolved)).otherwise(none)
    places = [F.when(gated, _phrase_places(padded, p)).otherwise(F.array().cast("array<int>")).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    rows = rows.select("doc_id", "n_words", found.alias("detections"), *places)
    all_places = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    rows = rows.select("doc_id", "n_words", "detections", all_places.alias("places"), base.alias("base"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    levels = F.transform("detections", lambda d: reduce(lambda x, p: x.when(d["priority"] == p, CONFIDENCE[p]), list(CONFIDENCE)[1:], F.when(d["priority"] == 3, CONFIDENCE[3])))
    score = F.greatest(F.coalesce(F.array_max(levels), F.lit(0.0)), F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        "detections",
    )
