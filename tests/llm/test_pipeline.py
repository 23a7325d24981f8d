from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_copies import grams, jaccard
from vantor.llm.mixing import taken_words
from vantor.llm.queries import QUERIES


WORD = re.compile("[^\x20\x09-\x0d]+")


def least_of_groups(rows):
    """The smallest id of each group of texts that links of five-word shingles, similar by 0.8 or more, connect."""
    sets, parent = {r.doc_id: grams(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {root(k) for k in ids}


def test_each_stage_against_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        counts[name] = (len(before), len(after))
        if name != "shard":
            assert docs.columns == columns
        ids = {r.doc_id for r in after}
        if name == "quality":
            kept = {r.doc_id for r in QUERIES["op8_quality_classifier"](spark, SF).where("kept").collect()}
            assert ids == kept
        if name == "dedup":
            assert ids == least_of_groups(before)
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            short = [(r.doc_id, r.text) for r in before if len(r.text) < 4000]
            assert {d for d, _ in short} - ids == {d for d, _ in brute(short, items)}
        if name == "mix":
            assert set(map(tuple, after)) <= set(map(tuple, before)) and max(Counter(r.doc_id for r in after).values()) <= 3
            size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
            target = {r.source: r.target for r in taken_words(spark.createDataFrame(before)).select("source_size", "target", "doc_id").join(spark.createDataFrame(before), "doc_id").collect()}
            for source, want in target.items():
                got = [size[r.doc_id] for r in after if r.source == source]
                assert abs(sum(got) - want) <= max(size[r.doc_id] for r in before if r.source == source)  # texts are not cut
        if name == "shard":
            assert docs.columns == [*columns, "shard", "slot"]
            sizes = Counter(r.shard for r in after)
            assert max(sizes.values()) - min(sizes.values()) <= 1
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    assert counts["dedup"][1] < counts["dedup"][0] and counts["decontaminate"][1] < counts["decontaminate"][0]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
