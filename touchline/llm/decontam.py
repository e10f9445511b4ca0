"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Texts and items are lower-cased (A-Z) words and their 5-word shingles; a shorter item is one shingle. For an item of w
words, windows of w words slide over every document; a document of fewer words is one window of its own size. A window's 64-bit SimHash (each shingle weighs as often as it
occurs) is looked up in a multi-index: the fingerprint is cut into BLOCKS blocks, and two fingerprints within RADIUS
bits agree in at least one block up to RADIUS // BLOCKS bits, so every item is filed under all block values that near.
Candidates within RADIUS are verified: weighted Jaccard similarity (sum of minima over sum of maxima of the shingles'
counts) of window and item of at least 0.75. RADIUS is four standard deviations above the expected distance (11 of 64
bits) at that similarity.

Two lossless steps keep the number of fingerprints small: a window can reach similarity 0.75 only if at least 6/7 of its
shingles are shingles of items of its size, and a running count of such shingles finds these windows. Windows of fewer
than 5 words are one shingle, so they are looked up by its hash alone.

The items are the stated query set. They are met in blocks of at most ITEM_BYTES of text, each broadcast; a further
block is a further pass over the documents.

Defined results: null and empty texts hold nothing; null and empty items, and items without words, are never found;
repeated items are each found; an empty table or benchmark gives no rows; repeated rows each give their rows; of overlapping windows of an item in a document the
most similar (then the first) is returned, and each place that overlaps no better one has its row.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import LOWER, Words, shingles, short_runs, slices, text_bytes

SHINGLE, NUM, DEN = 5, 3, 4
RADIUS, BLOCKS = 23, 8
ITEM_BYTES = 16 << 20
#: Windows fingerprinted at a time (512 bytes each while their bits are counted).
AT_ONCE = 20_000
#: Pairs of a window and an item that are looked up at a time (a byte each).
PAIRS = 20_000_000

SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"

_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    return sum(_ONES[((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int64) for k in range(4))


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 64 bits of each hash."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """64 sums a row to a fingerprint; a sum of 0 counts as a 1 bit."""
    return np.packbits(sums >= 0, axis=1).view(np.uint64).ravel()


class SizeClass:
    """All items with the same number of words, and their multi-index."""

    def __init__(self, words: int, ids: list[int], sets: list[np.ndarray]):
        self.words, self.ids, self.n = words, np.array(ids), max(1, words - SHINGLE + 1)
        self.counts = [np.unique(s, return_counts=True) for s in sets]
        self.prints = np.array([pack(signs(s).sum(axis=0, dtype=np.int64)[None, :])[0] for s in sets], dtype=np.uint64)
        self.known = np.unique(np.concatenate(sets))
        self.least = -(-2 * NUM * self.n // (NUM + DEN))  # shared shingles needed by two bags of n
        width, near = 64 // BLOCKS, RADIUS // BLOCKS
        values = np.arange(1 << width, dtype=np.uint64)
        self.index = []
        for b in range(BLOCKS):
            own = (self.prints >> np.uint64(width * b)) & np.uint64((1 << width) - 1)
            self.index.append(popcount(values[:, None] ^ own[None, :]) <= near)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within RADIUS; found by blocks, then measured."""
        width = 64 // BLOCKS
        met = np.zeros((len(prints), len(self.ids)), dtype=bool)
        for b in range(BLOCKS):
            met |= self.index[b][((prints >> np.uint64(width * b)) & np.uint64((1 << width) - 1)).astype(np.int64)]
        w, i = np.nonzero(met)
        d = popcount(prints[w] ^ self.prints[i])
        return w[d <= RADIUS], i[d <= RADIUS], d[d <= RADIUS]

    def similarity(self, window: np.ndarray, item: int) -> float:
        mine, n = np.unique(window, return_counts=True)
        known, m = self.counts[item]
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        shared = int(np.minimum(n, m[at])[known[at] == mine].sum())
        return shared / (n.sum() + m.sum() - shared)


def size_classes(items: list[tuple[int, bytes]]) -> list[SizeClass]:
    by: dict[int, tuple[list, list]] = {}
    for item, text in items:
        data = LOWER[np.frombuffer(text, dtype=np.uint8)]
        words = Words(data, np.array([0, len(data)]))
        if len(words.hashes):
            ids, sets = by.setdefault(len(words.hashes), ([], []))
            ids.append(item)
            sets.append(shingles(words.hashes, words.first, SHINGLE)[0])
    return [SizeClass(n, *by[n]) for n in sorted(by)]


def windows(hits: np.ndarray, begins: np.ndarray, ends: np.ndarray, n: int, least: int) -> np.ndarray:
    """Starts of runs of n shingles with at least least hits. hits: positions ascending; begins, ends: for each, its text's shingles."""
    if len(hits) < least:
        return np.zeros(0, dtype=np.int64)
    first, last = hits[: len(hits) - least + 1], hits[least - 1 :]
    lo, hi = np.maximum(last - n + 1, begins[: len(first)]), np.minimum(first, ends[: len(first)] - n)
    ok = (last - first < n) & (ends[: len(first)] == ends[least - 1 :]) & (lo <= hi)
    lo, hi = lo[ok], hi[ok]
    size = hi - lo + 1
    return np.unique(np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())) if len(lo) else lo


def best_places(found: list[tuple]) -> list[tuple]:
    """Of the windows of one item in one text, the best (most similar, then first) that overlap no better one."""
    starts, ends = [], []
    kept = []
    for x in sorted(found, key=lambda x: (-x[4], x[2])):
        k = bisect(starts, x[2])
        if (k == 0 or ends[k - 1] <= x[2]) and (k == len(starts) or x[2] + x[3] <= starts[k]):
            starts.insert(k, x[2])
            ends.insert(k, x[2] + x[3])
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


class Finder:
    """Items found in runs of texts."""

    def __init__(self, classes: list[SizeClass]):
        self.short, self.classes = [c for c in classes if c.words < SHINGLE], [c for c in classes if c.words >= SHINGLE]
        self.known = np.unique(np.concatenate([c.known for c in self.classes])) if self.classes else np.zeros(0, dtype=np.uint64)
        self.marks = np.zeros(1 << 20, dtype=bool)
        self.marks[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def find(self, words: Words) -> list[tuple[int, int, int, int, float, int]]:
        """(text, item id, start word, words, similarity, distance)."""
        by: dict[tuple, list] = {}
        for x in self._short(words) + self._long(words):
            by.setdefault(x[:2], []).append(x)
        return [x for k in sorted(by) for x in best_places(by[k])]

    def _short(self, words: Words) -> list[tuple]:
        out = []
        for c in self.short:
            runs = short_runs(words.hashes, c.words)
            hit = np.flatnonzero(np.isin(runs, c.known))
            text = np.searchsorted(words.first, hit, side="right") - 1
            inside = hit + c.words <= words.first[text + 1]
            for s, t in zip(hit[inside].tolist(), text[inside].tolist(), strict=True):
                out += [(t, int(c.ids[y]), s - int(words.first[t]), c.words, 1.0, 0) for y, (known, _) in enumerate(c.counts) if known[0] == runs[s]]
        return out

    def _long(self, words: Words) -> list[tuple]:
        out = []
        if not len(self.known):
            return out
        hashes, at = shingles(words.hashes, words.first, SHINGLE)
        hit = np.flatnonzero(self.marks[(hashes >> np.uint64(44)).astype(np.int64)])
        p = np.minimum(np.searchsorted(self.known, hashes[hit]), len(self.known) - 1)
        hit = hit[self.known[p] == hashes[hit]]
        if not len(hit):
            return out
        text = np.searchsorted(at, hit, side="right") - 1
        n_words, n_shingles = np.diff(words.first), np.diff(at)
        for c in self.classes:
            own = np.isin(hashes[hit], c.known)
            mine = hit[own]
            starts = windows(mine, at[text[own]], at[text[own] + 1], c.n, c.least)
            step = max(1, min(AT_ONCE, PAIRS // len(c.ids)))
            for k in range(0, len(starts), step):
                some = starts[k : k + step]
                # shingles from the first start on that some window covers, summed once
                span = np.unique((some[:, None] + np.arange(c.n)[None, :]).ravel())
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(hashes[span]), axis=0, dtype=np.int32)])
                a = np.searchsorted(span, some)
                w, i, d = c.candidates(pack(sums[a + c.n] - sums[a]))
                for x, y, z in zip(w, i, d, strict=True):
                    s = int(some[x])
                    like = c.similarity(hashes[s : s + c.n], int(y))
                    if like >= NUM / DEN:
                        t = int(np.searchsorted(at, s, side="right") - 1)
                        out.append((t, int(c.ids[y]), s - int(at[t]), c.words, like, int(z)))
            # texts of fewer words than the items, as one window each
            hits = np.bincount(text[own], minlength=len(n_words))
            for t in np.flatnonzero((n_words < c.words) & (hits > 0) & ((NUM + DEN) * hits >= NUM * (n_shingles + c.n))).tolist():
                bag = hashes[at[t] : at[t + 1]]
                _, i, d = c.candidates(pack(signs(bag).sum(axis=0, dtype=np.int64)[None, :]))
                for y, z in zip(i.tolist(), d.tolist(), strict=True):
                    like = c.similarity(bag, y)
                    if like >= NUM / DEN:
                        out.append((t, int(c.ids[y]), 0, int(n_words[t]), like, z))
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in hashed blocks of about limit bytes, each collected on its own."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // limit)
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        yield sorted((r["i"], r["t"].encode()) for r in rows)


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row per document, item and place that holds it, SCHEMA; documents without any have no row."""
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in item_blocks(benchmark, item_id, item_text, item_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(size_classes(shared.value))
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                ids = batch.column(0).to_pylist()
                for i, j in slices(offsets):
                    found = finder.find(Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]))
                    if found:
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i + t] for t, *_ in found], kinds[0]), *[pa.array(c, k) for c, k in zip(list(zip(*found, strict=True))[1:], kinds[1:], strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

        part = flat.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return flat.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents that hold no item, all columns as they are; no shuffle, a pass over what is left per block of items."""
    at_text = docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_id, item_text, item_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(size_classes(shared.value))
            for batch in batches:
                data, offsets = text_bytes(batch.column(at_text))
                good = np.ones(batch.num_rows, dtype=bool)
                for i, j in slices(offsets):
                    for t, *_ in finder.find(Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])):
                        good[i + t] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
