"""Near copies of the dedup stage: texts whose five-word shingles have an exact Jaccard similarity of 0.8, components.

Candidates come from SimHash fingerprints with deletion variants first. Those reach two bits, and pairs with a similarity
of 0.8 differ in ten of 64, so MinHash bands find what is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import cut, released, sized
from vantor.llm.components import connected_components
from vantor.llm.decontaminate import _mix, shingle_hashes

WIDTH = 5
SIMILARITY = 0.8
#: Texts with the same ROWS minima in one of BANDS bands are candidates: of pairs with a similarity of 0.8 that finds
#: 1 - (1 - 0.8 ** 8) ** 40 = 0.9993, of pairs with 0.5 one in seven, of pairs with 0.3 one in 400.
BANDS, ROWS = 40, 8
#: Bands are tried in two steps: pairs that fingerprints or the first bands connect need no comparison in the second.
STEPS = ((0, 8), (8, BANDS))
#: Four bits of each minimum are kept. Those of a pair with similarity s differ with probability (1 - s) * 15 / 16: of pairs
#: with 0.8 one in 2,000 differs in more than APART of the 320 minima, of pairs with 0.7 four in five, of pairs with 0.65 nearly all.
WORDS, APART = BANDS * ROWS // 16, 84
#: Shingles of so many bytes in all are sent to every task instead of being shuffled with the pairs.
SENT = 8 << 20
SEED = 42
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles of a text whose minima are taken at once, shingles held before they are passed on, words whose hashes a task
#: remembers.
STEP, HELD, MEMO = 1 << 9, 1 << 19, 200_000
#: A text that so many others are compared with is sent to several tasks, one for each so many.
SHARE = 256


class _Hashes(dict):
    """Hashes of words, as far as they are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: bytes | None, memo: dict | None = None) -> np.ndarray:
    """Sorted hashes of the text's distinct five-word shingles; a text of fewer words has one, of all its words."""
    words = (text or b"").lower().split()
    of = (_Hashes() if memo is None else memo).__getitem__
    ids = np.fromiter(map(of, words), dtype=np.uint64, count=len(words))
    return np.unique(shingle_hashes(ids, min(WIDTH, len(ids)))) if len(ids) else np.zeros(1, dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A signed 64-bit key for each band, and four bits of each minimum in WORDS longs."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        least = np.minimum(least, (hashes[at : at + STEP, None] * _FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    bits = (_mix(least + np.arange(len(least), dtype=np.uint64)) >> np.uint64(60)).astype(np.uint8)
    return key.view(np.int64), (bits[::2] << 4 | bits[1::2]).view(np.int64)


def simhash(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of a text's distinct shingles."""
    ones = sum(np.unpackbits(_mix(hashes[at : at + HELD]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(hashes), HELD))
    return int(np.packbits(ones * 2 > len(hashes)).view(np.int64)[0])


def signatures(texts: DataFrame) -> DataFrame:
    """(h, n, print, keys, bits) for each row of texts (h, text): n is the number of distinct shingles, bits some of their minima."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.large_binary()):  # one at a time: a batch's shingles would take much memory
                found = shingles(text.as_py(), memo)
                rows.append((len(found), simhash(found), *band_keys(found)))
            sizes, prints, keys, bits = zip(*rows, strict=True) if rows else ([],) * 4
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["h", "n", "print", "keys", "bits"])

    return texts.mapInArrow(run, "h long, n long, print long, keys array<long>, bits array<long>")


def shingle_table(texts: DataFrame) -> DataFrame:
    """(h, s): the shingles of each row of texts (h, text); some MB of them are held at a time."""
    of = lambda at, found: pa.record_batch([pa.array(at, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["h", "s"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            at, found, held = [], [], 0
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                at.append(h)
                found.append(shingles(text.as_py(), memo).view(np.int64))
                held += len(found[-1])
                if held >= HELD:
                    yield of(at, found)
                    at, found, held = [], [], 0
            yield of(at, found)

    return texts.mapInArrow(run, "h long, s array<long>")


def _near(p: str, q: str) -> Column:
    """Whether the bits of two texts, in columns of these names, are of minima that are near enough."""
    differ = "(x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & 1229782938247303441"  # the lowest bit of each four
    return F.expr(f"aggregate(zip_with({p}, {q}, (x, y) -> x ^ y), 0, (n, x) -> n + bit_count({differ})) <= {APART}")


def _with_bits(df: DataFrame, rows: DataFrame, h: str, letter: str, keys: bool = False) -> DataFrame:
    bits = rows.select(F.col("h").alias(f"__{letter}"), F.col("bits").alias(letter), *[F.col("keys").alias(f"{letter}_keys")] * keys)
    return df.join(bits, F.col(h) == F.col(f"__{letter}")).drop(f"__{letter}")


def printed(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints are equal or share a deletion variant and differ in two bits at most."""
    from vantor.llm.simhash_dedup import links

    least = cut(rows.groupBy("print").agg(F.min("h").alias("rep")))
    equal = rows.join(least, "print").where("h <> rep").select(F.col("rep").alias("a"), F.col("h").alias("b"))
    near = links(least.select("print")).toDF("x", "y").distinct()
    near = near.join(least.toDF("x", "p"), "x").join(least.toDF("y", "q"), "y")
    return equal.unionByName(near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))).distinct()


def measured(pairs: DataFrame, rows: DataFrame | None, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bits (in rows, if that isn't None) are near, with their exact similarity, alike. Many b may share an a.

    pairs must be written; their files are deleted. Shingles are joined and intersected in the JVM, a pair at a time, so that no batch of texts is ever held.
    """
    done = [pairs]
    if rows is not None:
        pairs = cut(_with_bits(_with_bits(pairs, rows, "a", "p"), rows, "b", "q").where(_near("p", "q")).select("a", "b"))
        done.append(pairs)
    leads = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("long").alias("shares")))
    wanted = cut(leads.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    known = texts.join(sized(wanted), "h", "left_semi").dropDuplicates(["h"])
    known = cut(shingle_table(known))
    total = known.agg(F.sum(F.size("s").cast("long") * 8 + 24)).first()[0] or 0
    if total <= SENT:
        both = pairs.join(F.broadcast(known.toDF("b", "sb")), "b").join(F.broadcast(known.toDF("a", "sa")), "a")
        found = cut(_alike(both))
        released(*done, leads, wanted, known)
        return found
    dealt = pairs.join(sized(leads), "a").withColumn("share", F.pmod(F.xxhash64("b"), "shares"))
    of_a = leads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    of_a = of_a.join(known.toDF("a", "sa"), "a")
    both = dealt.join(known.toDF("b", "sb"), "b").join(of_a, ["a", "share"])
    found = cut(_alike(both))
    released(*done, leads, wanted, known)
    return found


def _alike(both: DataFrame) -> DataFrame:
    both = both.select("a", "b", F.size("sa").alias("n"), F.size("sb").alias("m"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return both.select("a", "b", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("alike"))


def _fits(n: str, m: str) -> Column:
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _named(df: DataFrame, groups: DataFrame, h: str, name: str) -> DataFrame:
    """df with the group of h under that name; what is linked to nothing is a group of its own."""
    return df.join(sized(groups.toDF("__node", name)), F.col(h) == F.col("__node"), "left").drop("__node").withColumn(name, F.coalesce(name, h))


def near_copies(docs: DataFrame) -> DataFrame:
    """(h, component): for each distinct text of docs, by xxhash64, the smallest h that links of similar texts reach.

    Pairs of near fingerprints are measured first, then bands. A band's bucket is compared with its least h first. What
    isn't connected with that is compared with all in the bucket that may still be similar and isn't connected with it:
    the numbers of shingles fit, the bits are near, and so are the two distances to the least h, which bound the distance
    between (Jaccard distances obey the triangle inequality). So no pair is made within a bucket that is all alike, and a
    pair that shares buckets is made once.
    """
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    rows = cut(signatures(texts).groupBy("h").agg(*[F.first(c).alias(c) for c in ("n", "print", "keys", "bits")]))
    dealt = rows.select("h", "n", F.posexplode("keys").alias("band", "key"))
    buckets = dealt.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("h").alias("a"), F.min_by("n", "h").alias("m"))
    buckets = cut(buckets.where("size > 1").drop("size"))
    crowded = cut(dealt.join(sized(buckets), ["band", "key"]).where("h <> a"))
    released(buckets)
    tried = measured(cut(printed(rows)), rows, texts)
    for low, high in STEPS:
        groups = cut(connected_components(tried.where(F.col("alike") >= SIMILARITY).select("a", "b")))
        pairs = crowded.where((F.col("band") >= low) & (F.col("band") < high) & _fits("n", "m")).select("a", F.col("h").alias("b")).distinct()
        pairs = _named(_named(pairs, groups, "a", "ga"), groups, "b", "gb").where("ga <> gb").select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti")
        tried = tried.unionByName(measured(cut(pairs), rows, texts))
    groups = cut(connected_components(tried.where(F.col("alike") >= SIMILARITY).select("a", "b")))
    apart = _named(_named(crowded.select("band", "key", "h", "n", "a"), groups, "h", "g"), groups, "a", "ga")
    apart = apart.join(tried.toDF("a", "h", "alike"), ["a", "h"], "left")
    lost = cut(apart.where("g <> ga").select("band", "key", F.col("h").alias("x"), F.col("n").alias("m"), F.col("g").alias("gx"), F.col("alike").alias("alike_x")))
    near = F.coalesce(F.abs(F.col("alike") - F.col("alike_x")) <= 1 - SIMILARITY + 1e-9, F.lit(True))
    same = apart.select("band", "key", "h", "n", "g", "alike").join(sized(cut(lost.select("band", "key").distinct())), ["band", "key"], "left_semi")
    once = F.expr("array_position(zip_with(p_keys, q_keys, (x, y) -> x = y), true) = band + 1")  # in the first bucket that they share
    lost = _with_bits(lost, rows, "x", "q", keys=True)
    more = _with_bits(same, rows, "h", "p", keys=True).join(lost, ["band", "key"]).where((F.col("g") != F.col("gx")) & _fits("n", "m") & near & _near("p", "q") & once)
    more = more.select(F.least("h", "x").alias("a"), F.greatest("h", "x").alias("b")).distinct()
    more = cut(more.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    released(crowded)
    if more.limit(1).count():
        links = tried.unionByName(measured(more, None, texts)).where(F.col("alike") >= SIMILARITY)
        groups = cut(connected_components(links.select("a", "b")))
    return rows.select("h").join(groups, F.col("h") == F.col("node"), "left").select("h", F.coalesce("component", "h").alias("component"))
