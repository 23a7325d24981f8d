from __future__ import annotations

import random

import pytest

from tests.llm.conftest import SF
from vantor.llm.near_copies import _near, band_keys, near_copies, printed, shingles, signatures, simhash
from vantor.llm.simhash_dedup import keep_one


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("n", "edits"), [(60, 1), (100, 1), (200, 1), (200, 4), (400, 4), (1000, 10)])
def test_recall_of_edited_copies(spark, n, edits):
    rng = random.Random(n + edits)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        copy = list(words)
        for at in rng.sample(range(n), edits):
            copy[at] = f"x{rng.randrange(5000)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    alike = sum(jaccard(grams(a), grams(b)) >= 0.8 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert alike > 0 and len(rows) - len(kept) == alike
    assert kept >= {2 * k for k in range(60)}


def test_groups_against_all_pairs(spark):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(3)
    hub = [f"h{k}" for k in range(120)]  # a bucket whose members are not all similar to one another
    rows += [" ".join(f"y{k}.{rng.randrange(9)}" if rng.random() < 0.02 else w for k, w in enumerate(hub)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    names = {r.h: r.component for r in near_copies(frame).collect()}
    hashes = {r.text: r.h for r in frame.selectExpr("text", "xxhash64(text) AS h").collect()}
    texts = sorted(hashes, key=hashes.get)
    sets, parent = {t: grams(t) for t in texts}, {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)), key=hashes.get)
                parent[y] = x
    assert names == {hashes[t]: hashes[root(t)] for t in texts}


def edited(rng, words, edits):
    return " ".join(f"x{rng.randrange(10**6)}" if k in edits else w for k, w in enumerate(words))


def test_fingerprints_with_deletion_variants_give_candidates(spark):
    """The stage's named method: all pairs within two bits are connected, and they are measured before any band."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(5000)}" for _ in range(800)]
    rows = [(k, edited(rng, words, {rng.randrange(800)})) for k in range(60)] + [(100 + k, f"other text {k}") for k in range(5)]
    found = signatures(spark.createDataFrame(rows, "h long, text string")).cache()
    prints = {r.h: r.print for r in found.collect()}
    assert prints == {k: simhash(shingles(t.encode())) for k, t in rows}
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and prints[a] * prints[b] >= 0}
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    got = {(r.a, r.b) for r in printed(found).collect()}
    for a, b in got:
        parent[root(b)] = root(a)
    assert len(near) > 10 and all(root(a) == root(b) for a, b in near)


def test_bits_leave_out_half_similar_pairs(spark):
    """Pairs of a large group that are similar by 0.65 or less were measured one by one: one bit of a minimum kept a sixth of them."""
    rng, rows = random.Random(5), {True: [], False: []}
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        other = edited(rng, words, set(rng.sample(range(400), 7 if k % 2 else 19)))
        a, b = " ".join(words), other
        alike = jaccard(grams(a), grams(b))
        if alike >= 0.8 or alike <= 0.65:
            p, q = (band_keys(shingles(t.encode()))[1].tolist() for t in (a, b))
            rows[alike >= 0.8].append((p, q))
    share = {k: spark.createDataFrame(v, "p array<long>, q array<long>").where(_near("p", "q")).count() / len(v) for k, v in rows.items()}
    assert min(map(len, rows.values())) > 80 and share[True] >= 0.98 and share[False] <= 0.05


def test_measured_pairs_leave_no_files(spark):
    """Files of pairs and shingles stayed until the job's end, beside each other's and the shuffles that made them."""
    import os

    from vantor.llm.common import cut
    from vantor.llm.near_copies import measured

    texts = spark.createDataFrame([(k, "one two three four five six " + "seven " * (k % 2)) for k in range(6)], "h long, text string")
    pairs = cut(spark.createDataFrame([(0, 2), (0, 1), (1, 3)], "a long, b long"))
    of = lambda df: df._jdf.logicalPlan().rdd().getCheckpointFile().get().removeprefix("file:")
    root, before = os.path.dirname(of(pairs)), set(os.listdir(os.path.dirname(of(pairs))))
    found = measured(pairs, None, texts)
    assert {(r.a, r.b): r.alike for r in found.collect()} == {(0, 2): 1.0, (0, 1): 2 / 3, (1, 3): 1.0}
    assert set(os.listdir(root)) - before == {os.path.basename(of(found))} and not os.path.exists(of(pairs))
