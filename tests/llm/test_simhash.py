from __future__ import annotations

import random
from collections import Counter

import pytest
import xxhash

from tests.llm.conftest import SF
from vantor.llm.components import connected_components
from vantor.llm.queries import QUERIES
from vantor.llm.simhash_dedup import fingerprint, keep_one, links, near_duplicates


def slow_print(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def groups(prints):
    """{doc: smallest doc reachable}, by comparing all pairs of distinct fingerprints."""
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[root(p)] = min(d, least.get(root(p), d))
    return {(d, p): least.get(root(p)) for d, p in prints}


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, slow_print(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = groups(docs)
    got = QUERIES["op10_simhash_dedup"](spark, SF).collect()
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got} == want and len(got) == len(docs)
    assert all(len(r.fingerprint) == 16 for r in got)


def test_fingerprint_in_steps():
    text = " ".join(random.Random(1).choice("abcdefg") * 3 for _ in range(70_000))
    assert fingerprint(text.encode()) == slow_print(text)
    for t in (None, "", " \t", "One", "One two", "A B c", "É x y z"):
        assert fingerprint(t.encode() if t is not None else None) == slow_print(t)


def test_links_connect_all_near(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(63)
    prints = {rng.getrandbits(63) for _ in range(200)} | {0, centre} | {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(300)}
    found = links(spark.createDataFrame([(p,) for p in prints], "f long")).collect()
    assert all((r.a ^ r.b).bit_count() <= 2 + 2 for r in found)  # a star's arms share a ball
    names = {r.node: r.component for r in connected_components(links(spark.createDataFrame([(p,) for p in prints], "f long"))).collect()}
    want = groups([(p, p) for p in prints])
    assert Counter(names.get(p, p) for p in prints) == Counter(want[p, p] for p in prints)


def test_edges(spark, edge_docs, empty_docs):
    got = near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == 0 and by[3].component_id == 1
    assert by[6].component_id == by[5].component_id == 5 and by[None].component_id is None
    assert near_duplicates(empty_docs).count() == 0
    kept = keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(5) == 1 and 6 not in ids and 2 not in ids and None in ids


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(50)], [(0, k) for k in range(1, 60)] + [(100, 101), (101, 100), (100, 101)]])
def test_components(spark, edges):
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
    change = True
    while change:
        change = False
        for a, b in edges:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                change = True
    assert found == parent


def test_keep_one_loses_no_unrelated_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in ("apple", "river", "stone"))
    rows = [(5, a), (5, b), (3, a), (1, c), (1, c), *[(None, f"{x} " * 3 + " ".join(f"{x}{k}" for k in range(60))) for x in ("u", "v", "w", "w")]]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})
    assert {(r.doc_id, r.text) for r in kept if r.doc_id} == {(3, a), (5, b), (1, c)}
