from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tests.llm.conftest import SF
from vantor.llm.decontaminate import RADIUS, Index, _bits, _pack, contaminated, keep_clean, shingle_hashes, words_of
from vantor.llm.queries import QUERIES


def brute(texts, items):
    """Best window similarity of each (text, item) at 0.8 or more, over all windows of the item's length."""
    out = {}
    for d, text in texts:
        words = words_of((text or "").encode())
        for i, item in items:
            own = words_of((item or "").encode())
            if not own or not words:
                continue
            w = min(5, len(own))
            want = Counter(tuple(own[k : k + w]) for k in range(len(own) - w + 1))
            n = min(len(own), len(words))
            if n < w:
                continue
            best = 0.0
            for at in range(len(words) - n + 1):
                have = Counter(tuple(words[k : k + w]) for k in range(at, at + n - w + 1))
                both = sum((want & have).values())
                best = max(best, both / (sum(want.values()) + sum(have.values()) - both))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def changed(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return words


def test_planted_passages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 3, 5, 8, 30, 60, 60, 120])] + [(50, None), (51, " ... ")]
    docs = []
    for d in range(60):
        body = rng.choices(vocabulary, k=rng.choice([0, 5, 200, 700]))
        if d % 2:
            item = items[rng.randrange(3, 8)][1].split()
            at = rng.randrange(len(body) + 1)
            body[at:at] = changed(rng, item, min(len(item) // 25, rng.randrange(3)))
        docs.append((d, " ".join(x.upper() + "," if rng.random() < 0.2 else x for x in body)))
    want = brute(docs, items)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (50_000, 3):
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contaminated(frame, bench, most).collect()}
        assert got == want
    assert len(want) > 30
    assert sorted(r.doc_id for r in keep_clean(frame, bench).collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("n_chars").limit(120).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in QUERIES["op4_decontaminate"](spark, SF).collect()}
    ids = {d for d, _ in docs}
    assert {k: v for k, v in got.items() if k[0] in ids} == brute(docs, items) and got


def test_all_within_radius_are_candidates():
    rng = np.random.default_rng(5)
    index = Index([(k, " ".join(f"x{rng.integers(1000)}" for _ in range(40)).encode()) for k in range(50)])
    prints = index.prints[40]
    near = []
    for p in prints:
        flips = rng.choice(64, rng.integers(0, RADIUS + 4), replace=False)
        near.append(int(p) ^ sum(1 << int(b) for b in flips))
    asked = np.array(near, dtype=np.uint64)
    want = {(a, b) for a in range(50) for b in range(50) if (near[a] ^ int(prints[b])).bit_count() <= RADIUS}
    assert set(index.candidates(asked, 40)) == want


def test_print_is_the_majority():
    h = shingle_hashes(np.arange(1, 40), 5)
    got = int(_pack(_bits(h).sum(axis=0, keepdims=True), len(h))[0])
    assert got == sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h) * 2 > len(h))


def test_edges(spark, edge_docs, empty_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text here twice same text here twice"), (3, "same text here twice same text here twice")], "item_id long, text string")
    assert {r.doc_id for r in contaminated(edge_docs, bench).collect()} == {5, 6}
    assert contaminated(empty_docs, bench).count() == 0
    assert contaminated(edge_docs, bench.where("false")).count() == 0
    kept = keep_clean(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3


def test_ids_of_other_types(spark):
    text = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([("a", text), ("b", "nothing")], "doc_id string, text string")
    bench = spark.createDataFrame([(1.5, text)], "item_id double, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()] == [("a", 1.5)]
    assert [r.doc_id for r in keep_clean(docs, bench).collect()] == ["b"]


def test_windows_meet_only_items_with_a_common_shingle():
    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)).encode()) for k in range(3000)]
    index, most = Index(items), []
    plain = index.candidates
    index.candidates = lambda prints, length, some: most.append(len(some)) or plain(prints, length, some)
    text = b" ".join(x for k in (5, 77) for x in (b"some other words", items[k][1]))
    assert sorted(f[0] for f in index.find(text)) == [5, 77] and max(most) <= 2
