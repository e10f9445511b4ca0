"""Repeated passages by content-defined chunking with a gear rolling hash.

A text, lower-cased (A-Z) with white-space runs as one space, is cut after each byte at which the gear hash of the
last 32 bytes has MASK_BITS leading zeros. Cuts depend on nothing but these bytes, so that an insertion moves no
cut beyond 32 bytes after it, and a passage that two documents share is cut alike in both.

1.  Chunks are deduplicated by digest: (digest, smallest and largest document that holds it), combined before the
    shuffle. A digest with two documents is a repeated one.
2.  Repeated digests are put into a bit filter of a fixed size (FILTER_BITS), whatever the data; it is built by
    OR-ing 64-bit parts in a shuffle, and broadcast.
3.  A window of WORDS words can only repeat if all whole chunks inside it are repeated; windows that pass the filter
    (or have no whole chunk inside) are exchanged by their hash and those that two documents share are the answer.
    So the filter's false hits cost work but never change the result: it is exactly the runs of at least WORDS words
    that another document holds too.

What is removed are the windows that a document with a smaller id holds too, window by window: of a run that is shared
with several documents, each part goes from all but the first document that holds it.

Hot windows (a passage in a large part of all documents) are salted where they are joined back.

Defined results: null and empty texts and texts of fewer than WORDS words have no rows; repetition within one
document, or between rows with the same id, isn't one across documents; rows with a null id are left out, as there is
nothing to name them by; repeated rows give their passages once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import HOT_KEYS, HOT_ROWS, LOWER, NOT_SPACE, Words, checkpoint, range_hashes, rolling, salted_join, slices, text_bytes

WORDS = 50
#: Chunks have 2**MASK_BITS bytes on average.
MASK_BITS, REACH = 5, 32
FILTER_BITS = 28

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_FOLD = LOWER.copy()
_FOLD[~NOT_SPACE] = 32


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with white-space runs of a text as one space, and where each text begins."""
    data = _FOLD[data]
    space = data == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + G[byte] in 32 bits at each byte, by doubling the bytes summed; it runs across texts."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


class Chunks:
    """Whole chunks (from one cut to the next) of a run of texts, ascending: byte ranges, digests, texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data, offsets: as normalised() gives them."""
        cuts = np.flatnonzero(gear(data) >> np.uint32(32 - MASK_BITS) == 0) + 1  # a chunk ends before its cut
        text = np.searchsorted(offsets, cuts - 1, side="right") - 1
        own = cuts - REACH >= offsets[text]  # the bytes that decide a cut are all of its text
        self.cuts, text = cuts[own], text[own]
        whole = text[1:] == text[:-1]
        #: whether the chunk that ends at a cut is whole
        self.whole = np.concatenate([[False], whole]) if len(self.cuts) else np.zeros(0, dtype=bool)
        ends = np.flatnonzero(self.whole)
        self.ends, self.text = ends, text[ends]
        self.digests = range_hashes(data, self.cuts[ends - 1], self.cuts[ends])[0]


def chunk_digests(docs: DataFrame) -> DataFrame:
    """(d, id) of all whole chunks, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                chunks = Chunks(*normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                order = np.lexsort((chunks.text, chunks.digests))
                d, t = chunks.digests[order], chunks.text[order]
                new = np.ones(len(d), dtype=bool)
                new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(d[new].view(np.int64)), pa.array(ids[i + t[new]].astype(np.int64))], names=["d", "id"])

    return docs.filter("id is not null").select("id", "text").mapInArrow(run, "d long, id long")


def shared_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, first, rows): keys that rows with different ids have, with the smallest id."""
    return rows.groupBy(key).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows")).filter("first <> last").drop("last")


def bit_filter(repeated: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for the top bits of each digest d, as 2**bits / 64 words."""
    parts = repeated.select(F.shiftrightunsigned("d", 64 - bits).alias("at")).selectExpr("cast(shiftright(at, 6) as int) w", "shiftleft(1L, cast(at & 63 as int)) m").groupBy("w").agg(F.bit_or("m").alias("m"))
    rows = parts.toArrow()  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)
    return out


def candidate_windows(docs: DataFrame, marks: np.ndarray, words: int = WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """(h, id, pos): hashes of the windows of words words, from word pos on, that the filter can't rule out."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                own, at = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                w = Words(own, at)
                if not len(w.starts):
                    continue
                chunks = Chunks(own, at)
                top = chunks.digests >> np.uint64(64 - bits)
                seen = (known[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1)
                bad = np.zeros(len(chunks.cuts) + 1, dtype=np.int64)  # running count of whole chunks that aren't repeated, by their end
                bad[chunks.ends + 1] = 1 - seen.astype(np.int64)
                bad = np.cumsum(bad)
                text = np.repeat(np.arange(j - i), np.diff(w.first))
                last = np.arange(len(text)) + words - 1
                start = np.flatnonzero(last < w.first[1:][text])
                lo = np.searchsorted(chunks.cuts, w.starts[start] + REACH)
                hi = np.searchsorted(chunks.cuts, w.ends[last[start]], side="right") - 1
                ok = (hi <= lo) | (bad[np.maximum(hi, lo) + 1 - (hi < lo)] == bad[np.minimum(lo + 1, len(bad) - 1)])
                start = start[ok]
                h = rolling(w.hashes, start, words)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[i + text[start]].astype(np.int64)), pa.array((start - w.first[text[start]]).astype(np.int32))], names=["h", "id", "pos"])

    return docs.filter("id is not null").select("id", "text").mapInArrow(run, "h long, id long, pos int")


def _runs(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """repeated_passages' rows as (id, start_word, n_words, first_doc), with the parts (start, n) of each that a smaller id holds too."""
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = bit_filter(shared_by(chunk_digests(flat), "d"), bits)
    found = candidate_windows(flat, marks, words, bits)
    repeated = checkpoint(shared_by(found, "h"))
    hot = [tuple(r) for r in repeated.filter(F.col("rows") >= HOT_ROWS).orderBy(F.desc("rows"), "h").limit(HOT_KEYS).select("h", "rows").collect()]
    held = salted_join(found, repeated.select("h", "first"), "h", "id", hot=hot).withColumn("earlier", F.col("first") < F.col("id"))
    run = F.col("pos") - F.dense_rank().over(Window.partitionBy("id").orderBy("pos"))
    part = F.col("pos") - F.dense_rank().over(Window.partitionBy("id", "earlier").orderBy("pos"))
    parts = held.withColumn("run", run).withColumn("part", part).groupBy("id", "run", "earlier", "part").agg(F.min("pos").cast("long").alias("lo"), F.max("pos").cast("long").alias("hi"), F.min("first").alias("first"))
    spans = F.collect_list(F.when(F.col("earlier"), F.struct(F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + words).alias("n"))))
    return parts.groupBy("id", "run").agg(F.min("lo").alias("start_word"), (F.max("hi") - F.min("lo") + words).alias("n_words"), F.min("first").alias("first_doc"), spans.alias("parts")).drop("run")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """(id, start_word, n_words, first_doc): each maximal run of words in which every window of words words is held by another
    document; first_doc is the smallest id that holds one of its windows. Documents without any have no row."""
    return _runs(docs, id_col, text_col, words, bits).drop("parts").withColumnRenamed("id", id_col)


def _kept(texts: DataFrame) -> DataFrame:
    """(id, text, parts) to (id, kept, n_kept, kept_crc32): the texts without the words of their parts, joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n = [], []
            for text, parts in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                w, out, at = (text.as_py() or b"").split(), [], 0  # bytes are split at the six white-space bytes
                for a, m in sorted((p["start"], p["n"]) for p in parts.as_py() or ()):
                    out += w[at:a]
                    at = max(at, a + m)
                out += w[at:]
                kept.append(b" ".join(out))
                n.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in kept], pa.int64())], names=["id", "kept", "n_kept", "kept_crc32"])

    return texts.select("id", "text", "parts").mapInArrow(run, "id long, kept string, n_kept long, kept_crc32 long")


def _parts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("id").agg(F.flatten(F.collect_list("parts")).alias("parts"))


def passages_and_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """repeated_passages' rows with their document's n_kept and kept_crc32: words, and crc32 of the text, that drop_repeats leaves.

    A document without passages has no row; all its words are kept. Rows with the same id count as one document.
    """
    runs = checkpoint(_runs(docs, id_col, text_col, words, bits))
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = _kept(flat.join(_parts(runs), "id")).groupBy("id").agg(F.max(F.struct("n_kept", "kept_crc32")).alias("x")).select("id", "x.*")
    return runs.drop("parts").join(kept, "id").withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, kept): each text's words without the windows that a document with a smaller id holds too; texts are re-joined by single spaces."""
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _kept(flat.join(_parts(_runs(docs, id_col, text_col, words, FILTER_BITS)), "id", "left")).select(F.col("id").alias(id_col), "kept")
