from __future__ import annotations

import re
from collections import Counter

import pytest

from tests.llm.conftest import SF
from vantor.llm import line_dedup, quality_rules
from vantor.llm.license_rules import CONFIDENCE, GATES, RULES
from vantor.llm.license_scan import PHRASES, scan
from vantor.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in PHRASES.items()}
    every = sorted(x for v in places.values() for x in v)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in places.items() if v))


def detections(text):
    """All rules at all words, then what no other of the same or a higher priority contains."""
    words = WORD.findall((text or "").translate(LOWER))
    padded = f" {' '.join(words)} "
    found = set()
    for label, priority, _, pattern in RULES:
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", padded):
            first = padded[: m.start()].count(" ") - 1
            found.add((first, first + m.group().count(" "), priority, label))
    keep = []
    for d in found:
        beaten = any(o != d and o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and (o[:3] != d[:3] or o[3] < d[3]) for o in found)
        if not beaten:
            keep.append(d)
    return sorted(keep)


TEXTS = [
    "Licensed under CC-BY 4.0; CC BY. cc  by", "GNU General Public License version 2", "All Rights Reserved. all rights reserved all rights reserved", "SPDX-License-Identifier: MIT", "Released under the MIT License.",
    "Copyright (c) 2020 Some Body Here. All rights reserved.", "apache license version 2.0 apache license", "cc bye, xcc by, cc by", "general public license general public license", "", None, "É cc by ñ", "the public domain dedication in the public domain", "cc\x00by cc\nby CC_BY",
    "BSD 3-Clause License and new BSD license; LGPL v2.1, AGPLv3; licensed under the Foo license", "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "Unauthorised copying of this file, via any medium, is strictly prohibited.", "Released as CreativeML Open RAIL-M", "see ASL 2.0 for terms",
]


def test_license_scan_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in scan(rows).collect():
        text = TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        want = detections(text)
        assert sorted(map(tuple, r.detections)) == want, text
        assert r.labels == ",".join(sorted({d[3] for d in want} | set(filter(None, r.base_labels.split(",")))))
        assert r.score == max([CONFIDENCE[d[2]] for d in want] + [0.6 * bool(r.base_labels)])


def test_license_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_license_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in got)
    for r in scan(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert sorted(map(tuple, r.detections)) == detections(texts[r.doc_id])


def test_license_rules_and_gates():
    assert len(RULES) >= 200
    for _, _, key, _ in RULES:
        assert any(g in key for g in GATES), key


def test_license_edges(edge_docs, empty_docs):
    assert scan(edge_docs).count() == edge_docs.count() and scan(empty_docs).count() == 0


def counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_edges(edge_docs, empty_docs):
    rows = edge_docs.collect()
    got = quality_rules.filter_rules(edge_docs).collect()
    want = sorted((str(r.doc_id), *counts(r.text)) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality_rules.filter_rules(empty_docs).count() == 0


def test_sketch_quantiles(spark):
    rows = spark.range(5000).selectExpr("'en' AS lang", "cast(id % 2 AS string) AS source", "100L AS n_words", "500 + id AS word_chars", "0L AS n_symbols", "0L AS n_dup_lines", "1L AS n_lines", "0L AS n_repeat_words")
    q = quality_rules.quantiles(quality_rules.sketches(rows), ["lang"]).where("metric = 'word_length'").first()
    assert q.rows == 5000 and abs(q.q1 / (500 + 1250) - 1) < 0.02 and abs(q.q3 / (500 + 3750) - 1) < 0.02
    halves = [quality_rules.sketches(rows.where(f"source = '{k}'")) for k in (0, 1)]
    merged = quality_rules.quantiles(halves[0].unionByName(halves[1]), ["lang"]).where("metric = 'word_length'").first()
    assert merged == q


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def line_groups(rows):
    """{(doc_id, line): removed} by comparing all lines in full: nothing of the operator's keys is used."""
    lines = [(d, k, norm) for d, text in rows for k, x in enumerate(text.split("\n")) if (norm := re.sub("[^0-9a-z]+", " ", x.lower()).strip())]
    texts = sorted({t for _, _, t in lines})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    links = []
    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            n = max(len(a), len(b))
            if min(len(a), len(b)) >= 0.8 * n and levenshtein(a, b) <= int(0.2 * n + 1e-9):
                links.append((a, b))
                parent[root(a)] = root(b)
    seen, gone = set(), set()
    for d, k, t in sorted(lines):
        gone |= {(d, k)} if root(t) in seen else set()
        seen.add(root(t))
    return gone, links


@pytest.mark.parametrize("metric", ["word_length", "symbols", "dup_lines", "repeats"])
def test_each_fence_alone_rejects(spark, metric):
    """A text that passes the base rules goes for one metric, by which it stands far from its source; all others stay."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))

    def ordinary(k):
        lines = [" ".join(word() for _ in range(20)) for _ in range(20)]
        if k % 3 == 0 and metric != "repeats":  # one line or two stand twice, as is usual here
            lines[5] = lines[6]
        if k % 6 == 0 and metric != "repeats":
            lines[7] = lines[8]
        if k % 3 == 1:
            lines[9] += " " + " ".join(lines[10].split()[: rng.randrange(3, 7)])
        return lines

    lines = ordinary(2)
    if metric == "word_length":
        lines = [x.replace(" ", "longer ") for x in lines]
    if metric == "symbols":
        lines = [x.replace(" ", "# ", 4) for x in lines]
    if metric == "dup_lines":
        lines = lines[:2] + [lines[0].split()[0] + "."] * 15  # words of these lines are no tenth of the text
        lines[:2] = [" ".join(word() for _ in range(150)) for _ in range(2)]
    if metric == "repeats":
        lines[10:13] = [" ".join(lines[k].split()[::-1]) for k in range(3)]
        lines[13:17] = [f"{word()} " + lines[k] for k in range(4)]
    rows = [(k, "\n".join(ordinary(k)), "en", "s") for k in range(600)] + [(1000, "\n".join(lines), "en", "s")]
    got = {r.doc_id: (r.base_failed, r.kept, list(r.failed_rules)) for r in quality_rules.filter_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got.pop(1000) == (False, False, [metric])
    assert sum(not v[1] for v in got.values()) <= 3


VOCABULARY = [f"{a}{b}{c}{d}" for a in "bdfg" for b in "aeiou" for c in "klmnr" for d in ("", "ing", "ation", "ster", "a")]


def edited(rng, words):
    """Words changed, left out, added, or some letters mistyped."""
    words = list(words)
    for _ in range(rng.randrange(1 + len(words) // 8)):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    if len(words) > 3 and rng.random() < 0.3:
        words.pop(rng.randrange(len(words)))
    if rng.random() < 0.3:
        words.insert(rng.randrange(len(words) + 1), rng.choice(VOCABULARY))
    if rng.random() < 0.3:
        w = rng.randrange(len(words))
        words[w] = words[w][:-1] + rng.choice("xyz")
    line = rng.choice([" ", ", "]).join(words)
    return line.upper() if rng.random() < 0.2 else line


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_brute_force(spark, seed):
    """No line goes that full comparison keeps; of those that it finds at least 0.97 go."""
    import random

    rng = random.Random(seed)
    pool = [rng.choices(VOCABULARY, k=rng.choice([1, 2, 3, 4, 5, 7, 10, 15, 25, 40])) for _ in range(50)]
    rows = [(d, "\n".join(edited(rng, rng.choice(pool)) if rng.random() < 0.9 else "" for _ in range(rng.randrange(8)))) for d in range(60)]
    want, links = line_groups(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, k) for r in got for k in r.removed_lines}
    assert found <= want and len(found) >= 0.97 * len(want) and len(links) > 50
    assert sum(r.n_lines for r in got) == sum(1 for _, t in rows for x in t.split("\n") if x)


def test_line_dedup_recall_of_links(spark, docs):
    """All pairs of the documents' lines with an edit similarity of 0.8, compared in full, against the pairs that share a key."""
    from pyspark.sql import functions as F

    keys = line_dedup.distinct_lines(docs).select("id", line_dedup._keys().alias("keys")).dropDuplicates(["id"])
    texts = docs.select(F.explode(line_dedup._lines(F.col("text"))["x"]).alias("x")).select(line_dedup.normalised(F.col("x")).alias("t")).distinct()
    lines = keys.join(texts.select(F.xxhash64("t").alias("id"), "t"), "id").cache()
    a, b = lines.toDF("a", "ka", "ta"), lines.toDF("b", "kb", "tb")
    most = F.floor(F.greatest(F.length("ta"), F.length("tb")) * 0.2).cast("int")
    near = a.join(b, (F.col("a") < F.col("b")) & (F.least(F.length("ta"), F.length("tb")) >= 0.8 * F.greatest(F.length("ta"), F.length("tb"))))
    near = near.where(F.call_function("levenshtein", F.col("ta"), F.col("tb"), most) >= 0)
    n, found = near.agg(F.count("*"), F.count_if(F.arrays_overlap("ka", "kb"))).first()
    assert n >= 20 and found >= 0.95 * n


@pytest.mark.parametrize("n", [3, 5, 12, 20, 60, 257])
def test_line_dedup_recall_by_length(spark, n):
    """Pairs of lines of n words of which one letter, a tenth or (for longer lines) a fifth of the words changed, or one was added."""
    import random

    rng = random.Random(n)
    rows = []
    for k in range(120):
        words = rng.choices(VOCABULARY, k=n)
        other = list(words)
        if k % 3 == 0:
            w = rng.randrange(n)
            at = rng.randrange(len(other[w]))
            other[w] = other[w][:at] + "x" + other[w][at + 1 :]
        elif k % 3 == 1:
            other.append(rng.choice(VOCABULARY))
        else:
            for w in rng.sample(range(n), n // 10 if n < 12 else n // 6):
                other[w] = rng.choice(VOCABULARY)
        a, b = " ".join(words), " ".join(other)
        if a != b and levenshtein(a, b) <= 0.2 * max(len(a), len(b)):
            rows += [(2 * k, a), (2 * k + 1, b)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.values()) >= 0.95 * len(rows) / 2 >= 20


def test_line_dedup_edges(spark, edge_docs, empty_docs):
    got = line_dedup.dedup_lines(edge_docs).collect()
    assert len(got) == edge_docs.count() and line_dedup.dedup_lines(empty_docs).count() == 0
    assert sum(r.n_removed for r in got) == 4  # the repeated row and the other copy
    long_line = " ".join(f"w{k}" for k in range(20_000))
    rows = spark.createDataFrame([(1, long_line), (2, long_line + "\nshort line"), (3, "short line")], "doc_id long, text string")
    out = {r.doc_id: (r.n_lines, list(r.removed_lines)) for r in line_dedup.dedup_lines(rows).collect()}
    assert out == {1: (1, []), 2: (2, [0]), 3: (1, [0])}
    close = [(1, "Terms of service"), (2, "Terms of services"), (3, "read our privacy policy and the terms of use before you open an account here"), (4, "read our privacy policies and the terms of use before you open an account here")]
    close += [(5, " ".join(f"part{k}" for k in range(256))), (6, " ".join(f"part{k}" for k in range(257)))]
    pairs = line_dedup.dedup_lines(spark.createDataFrame(close, "doc_id long, text string")).collect()
    assert {r.doc_id for r in pairs if r.n_removed} == {2, 4, 6}
    cleaned = {r.doc_id: r.text for r in line_dedup.cleaned(rows).collect()}
    assert cleaned == {1: long_line, 2: "short line", 3: ""}


@pytest.mark.parametrize("n", [2, 3])
def test_line_dedup_finds_all_replaced_letters_in_short_lines(spark, n):
    """Both halves of such a line may have changed letters, so that neither its beginning nor its end is whole."""
    import random

    rng, rows = random.Random(n), []
    for k in range(150):
        a = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(5, 9))) for _ in range(n))
        b = list(a)
        for at in rng.sample([i for i, x in enumerate(a) if x != " "], max(2, len(a) // 5) if k % 2 else 2):
            b[at] = "x"
        rows += [(2 * k, a), (2 * k + 1, "".join(b))]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 0 and got[2 * k + 1] == 1 for k in range(150))


def test_line_dedup_makes_no_pairs_of_chance_keys(spark, monkeypatch):
    """Lines that share two long words and little else were each joined with every other and its text; similar ones still are."""
    import random

    from pyspark.sql import functions as F

    rng, made = random.Random(4), []
    lines = [" ".join(["characteristically"] + rng.choices(VOCABULARY, k=10) + ["incomprehensibility"] + rng.choices(VOCABULARY, k=10)) for _ in range(80)]
    rows = list(enumerate(lines + [x.replace("incompre", "incombre") for x in lines[:10]]))
    real = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, texts: made.append(pairs.count()) or real(pairs, texts))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, n in got.items() if n} == set(range(80, 90)) and sum(made) < 500
    # whatever the masks leave out, the full comparison rejects
    short = [" ".join(x.split()[:4]) for x in lines[:30]]
    texts = line_dedup.cut(spark.createDataFrame([(k, x) for k, x in enumerate(lines[:10] + [x + " more" for x in lines[:10]] + short + [x[:-2] + "xy" for x in short])], "id long, t string"))
    of = line_dedup.masks(texts)
    pairs = line_dedup._masked(line_dedup._masked(texts.select(F.col("id").alias("a")).crossJoin(texts.select(F.col("id").alias("b"))).where("a < b"), of, "a", "p"), of, "b", "q")
    left_out = pairs.where(~line_dedup._may()).select("a", "b")
    assert left_out.count() > 1000 and line_dedup.verified(left_out, texts).count() == 0


def test_line_dedup_excludes_pairs_by_hubs(spark, monkeypatch):
    """Two large groups of near copies that share half their words: each line of one was compared with each of the other."""
    import random

    rng, made = random.Random(7), []
    one = rng.choices(VOCABULARY, k=60)
    two = [rng.choice(VOCABULARY) if k % 30 < 15 else w for k, w in enumerate(one)]
    copies = lambda words: [" ".join(w + "x" if k == at else w for k, w in enumerate(words)) for at in range(40)]
    rows = list(enumerate([x for pair in zip(copies(one), copies(two), strict=True) for x in pair]))
    real = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, texts: made.append(pairs.count()) or real(pairs, texts))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: int(k > 1) for k, _ in rows}  # a line of each group stays
    assert len(made) == 2 and made[1] < 1000  # 1357 before


def test_released_frames_leave_no_files(spark):
    import os

    from vantor.llm.common import cut, released

    frame = cut(spark.range(100).repartition(3))
    path = frame._jdf.logicalPlan().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.listdir(path)
    released(frame)
    assert not os.path.exists(path)
