"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WIDTH = 5
SIMILARITY = 0.8
#: Fingerprints within so many bits are found for certain: four blocks of 16 bits, one of which differs in RADIUS // 4.
RADIUS = 19
BLOCKS = 4
#: Items that one pass over the documents looks for; more items take more passes.
MAX_ITEMS = 50_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_POP = np.array([x.bit_count() for x in range(1 << 16)], dtype=np.uint8)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (folded to lower case), digits and other than ASCII characters."""
    return (text or b"").translate(_FOLD).split()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that each bit of a shingle's hash is a fair coin."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` word numbers."""
    n = len(ids) - width + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(k + 1))
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def _pack(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").reshape(-1)


class Index:
    """The items by length: numbers of their words, SimHash, its blocks, shingle weights; and by shingle.

    A window is looked at only where a shingle of some item stands, and only against the items that have a shingle
    there (the others have similarity 0), so what is held at once doesn't grow with the number of items.

    A shingle weighs the number of times it occurs, so that the similarity of two passages is the sum of the smaller
    weights over that of the larger ones. Items of fewer than five words are one shingle, of all their words.
    """

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[int, list] = defaultdict(list)  # by length: (item_id, weights)
        prints: dict[int, list[int]] = defaultdict(list)
        hashes: dict[int, list[tuple]] = defaultdict(list)  # by width: (shingle, length, place among the items of that length)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64)
            width = min(WIDTH, len(ids))
            h = shingle_hashes(ids, width)
            distinct = np.unique(h)
            hashes[width].append((distinct, np.full(len(distinct), len(ids)), np.full(len(distinct), len(self.items[len(ids)]))))
            self.items[len(ids)].append((item_id, Counter(h.tolist())))
            prints[len(ids)].append(int(_pack(_bits(h).sum(axis=0, keepdims=True), len(h))[0]))
        self.known, self.owners = {}, {}
        for width, parts in hashes.items():
            h, length, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.known[width], first = np.unique(h[order], return_index=True)
            self.owners[width] = (np.append(first, len(h)), length[order], place[order])
        self.prints = {n: np.array(v, dtype=np.uint64) for n, v in prints.items()}
        self.blocks = {n: self.split(v) for n, v in self.prints.items()}

    @staticmethod
    def split(prints: np.ndarray) -> np.ndarray:
        return np.stack([(prints >> np.uint64(16 * b)) & np.uint64(0xFFFF) for b in range(BLOCKS)], axis=1).astype(np.uint16)

    def owning(self, width: int, shingles: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the places of the items that have one of the shingles (numbers in self.known)."""
        ends, lengths, places = self.owners[width]
        shingles = np.unique(shingles)
        sizes = ends[shingles + 1] - ends[shingles]
        at = np.arange(sizes.sum()) + np.repeat(ends[shingles] - np.cumsum(sizes) + sizes, sizes)
        lengths, places = lengths[at], places[at]
        return {int(n): np.unique(places[lengths == n]) for n in np.unique(lengths)}

    def candidates(self, prints: np.ndarray, length: int, items: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """(window, item) pairs within RADIUS: one block at least is within RADIUS // BLOCKS, then all bits count."""
        items = np.arange(len(self.prints[length])) if items is None else items
        mine, own = self.split(prints), self.blocks[length][items]
        near = np.zeros((len(prints), len(items)), dtype=bool)
        for b in range(BLOCKS):
            near |= _POP[mine[:, b, None] ^ own[None, :, b]] <= RADIUS // BLOCKS
        at, item = np.nonzero(near)
        apart = prints[at] ^ self.prints[length][items[item]]
        distance = _POP[self.split(apart)].sum(axis=1)
        for k in np.nonzero(distance <= RADIUS)[0]:
            yield int(at[k]), int(items[item[k]])

    def find(self, text: bytes | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of each item that some window of the text repeats."""
        words = words_of(text)
        if not words:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        best: dict[int, tuple[float, int, int]] = {}
        for width, known in self.known.items():
            n = len(ids) - width + 1
            if n < 1:
                continue
            inside = np.concatenate([[0], np.cumsum(ids > 0)])
            full = np.nonzero(inside[width:] - inside[:-width] == width)[0]
            if not len(full):
                continue
            # a window without any of the items' shingles has similarity 0 to all of them
            found = self._hash_at(ids, full, width)
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            same = known[place] == found
            if same.any():
                self._windows(ids, full[same], place[same], width, best)
        return [(item, *v) for item, v in best.items()]

    @staticmethod
    def _hash_at(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64) + np.uint64(k + 1))
        return out

    def _windows(self, ids: np.ndarray, hits: np.ndarray, shingles: np.ndarray, width: int, best: dict) -> None:
        # Words outside the vocabulary differ from all items' words; they are told apart by where they stand.
        ids = np.where(ids > 0, ids, len(self.vocabulary) + 1 + np.arange(len(ids)))
        longest = max(n for n in self.items if min(WIDTH, n) == width)
        # far hits, and those of a long text every so often, are looked at apart; each part has all windows around its hits
        cuts = np.nonzero((np.diff(hits) > 2 * longest) | (np.diff(hits // 8192) > 0))[0] + 1
        for part, inside in zip(np.split(hits, cuts), np.split(shingles, cuts), strict=True):
            low, high = max(0, part[0] - longest), min(len(ids), part[-1] + width + longest)
            h = shingle_hashes(ids[low:high], width)
            sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(_bits(h), axis=0, dtype=np.int32)])
            hit = np.zeros(len(h) + 1, dtype=np.int64)
            hit[part - low + 1] = 1
            hit = np.cumsum(hit)
            # windows of this part may hold hits of its neighbours too: those are found with these
            near = self.owning(width, np.concatenate([inside, shingles[(hits >= low) & (hits < high)]]))
            for length, some in near.items():
                items = self.items[length]
                m = min(length - width + 1, len(h))  # a text shorter than the item is one window
                starts = np.nonzero(hit[m:] > hit[:-m])[0]
                if not len(starts):
                    continue
                prints = _pack(sums[starts + m] - sums[starts], m)
                for at, item in self.candidates(prints, length, some):
                    item_id, weights = items[item]
                    s = int(starts[at])
                    mine = Counter(h[s : s + m].tolist())
                    both = sum(min(c, weights.get(k, 0)) for k, c in mine.items())
                    alike = both / (m + length - width + 1 - both)
                    if alike >= SIMILARITY and (item_id not in best or (-alike, s + low) < (-best[item_id][0], best[item_id][1])):
                        best[item_id] = (alike, s + int(low), m + width - 1)


def _slices(benchmark: DataFrame, max_items: int) -> Iterator[Index]:
    """Indexes of at most about max_items items each."""
    rows = benchmark.select("item_id", "text").dropna()
    n = max(1, -(-rows.count() // max_items))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index([(r.item_id, r.text.encode()) for r in part.sort("item_id", "text").collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the most similar window of each row of docs for each item.

    Only windows of similarity 0.8 or more count; clean rows give none. Null and empty texts and items match nothing;
    equal items match alike; ties go to the first window. The items of one pass are bounded by max_items; a larger
    benchmark takes as many passes as needed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long"
    out = None
    for index in _slices(benchmark, max_items):

        def run(batches: Iterable[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(k, *found) for k, t in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()) for found in index.find(t)]
                at, items, alike, first, n = zip(*rows, strict=True) if rows else ([], [], [], [], [])
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, item_type), pa.array(alike, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())]
                yield pa.record_batch(columns, names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The rows of docs that repeat no item, with all their columns; nothing is shuffled."""
    for index in _slices(benchmark, max_items):

        def run(batches: Iterable[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not index.find(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
