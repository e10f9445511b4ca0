"""Product codes of vectors: codebooks by Lloyd rounds whose sums are maintained by differences.

Vectors become integer vectors, floor(SCALE * component), cut into PARTS parts; all arithmetic is on integers and exact. The
vectors are written once, bucketed by a row number, and so are each round's assignments (one byte a part). A round joins
the two bucket by bucket, without a shuffle, assigns each part to its nearest entry, and adds up what changes: plus at the new
entry, minus at the old one, for parts whose assignment changed, per task. Only these sums are shuffled; the driver
adds them to its running sums and counts, whose size is that of the codebooks, and sends new codebooks to all tasks.

Everything between rounds stands in tables in the shared folder, so lost executors cost their tasks only.

Defined results: a vector that is null or holds null or non-finite components is dropped; a shorter vector counts as padded
with zeros, to the longest and to a multiple of PARTS; with fewer rows than entries the codebooks are shorter, and equal
entries stay (the lower index wins); rows alike in id are ordered by vector, null ids come last; a component beyond the
range of a long takes its bound; an error that no long can hold is null, and isn't part of its label's sum. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import salted_join, shared_folder, store
from touchline.llm.whitening import MOST, matrix, padded, scaled, usable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Numbers in a bucket of the table of vectors, about; most labels whose sums are broadcast.
BUCKET_VALUES, LABELS = 4_000_000, 100_000
_SUM = pa.decimal128(38, 0)
_DELTA = "array<struct<part: int, entry: int, count: long, sums: array<decimal(38,0)>>>"


def nearest(part: np.ndarray, book: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry, ties to the lower index. most: of the absolute values."""
    if 4 * part.shape[1] * most * most < 1 << 53:  # doubles are exact
        p, b = part.astype(np.float64), book.astype(np.float64)
        apart = (b * b).sum(axis=1) - 2 * (p @ b.T)
        index = apart.argmin(axis=1)
        return index, (apart[np.arange(len(p)), index] + (p * p).sum(axis=1)).astype(np.int64)
    p, b = part.astype(object), book.astype(object)
    apart = np.stack([((p - entry) ** 2).sum(axis=1) for entry in b], axis=1)
    index = np.array([min(range(len(b)), key=row.__getitem__) for row in apart], dtype=np.int64)
    return index, apart[np.arange(len(p)), index]


def _round(width: int, books: list[np.ndarray], most: int, first: bool):
    """New assignments (row, codes); the last row of a task carries the sums of what changed in it."""
    m = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus = [np.zeros((len(books[0]), m), dtype=object) for _ in range(PARTS)]
        count = np.zeros((PARTS, len(books[0])), dtype=np.int64)
        touched, held = np.zeros((PARTS, len(books[0])), dtype=bool), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), width)
            old = None if first else np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(len(x), PARTS)
            new = np.empty((len(x), PARTS), dtype=np.uint8)
            for p in range(PARTS):
                part = x[:, p * m : p * m + m]
                new[:, p] = nearest(part, books[p], most)[0]
                moved = np.ones(len(x), dtype=bool) if first else new[:, p] != old[:, p]
                for sign, codes in ((1, new[moved, p]),) + (() if first else ((-1, old[moved, p]),)):
                    here = np.unique(codes)
                    touched[p, here] = True
                    count[p] += sign * np.bincount(codes, minlength=len(books[0]))
                    exact = part[moved] if most * len(x) < MOST else part[moved].astype(object)
                    sums = np.zeros((len(books[0]), m), dtype=exact.dtype)
                    np.add.at(sums, codes, exact)
                    plus[p][here] += sign * sums[here].astype(object)
            codes = pa.array([bytes(c) for c in new], pa.binary())
            out = [batch.column("row"), codes]
            if held is not None:
                yield _assigned(*held, None)
            held = out
        if held is not None:
            delta = [{"part": int(p), "entry": int(e), "count": int(count[p, e]), "sums": [Decimal(int(v)) for v in plus[p][e]]} for p, e in zip(*np.nonzero(touched), strict=True)]
            yield _assigned(*held, delta)

    return run


def _assigned(row: pa.Array, codes: pa.Array, delta: list | None) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(_SUM))]))
    return pa.RecordBatch.from_arrays([row, codes, pa.array([None] * (len(row) - 1) + [delta], kind)], ["row", "codes", "delta"])


def _coded(width: int, books: list[np.ndarray], most: int):
    m = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            found = [nearest(x[:, p * m : p * m + m], books[p], most) for p in range(PARTS)]
            code = ["".join(f"{k:02x}" for k in row) for row in zip(*(k.tolist() for k, _ in found), strict=True)]
            error = [e if e <= MOST else None for e in map(sum, zip(*(d.tolist() for _, d in found), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


class _Tables:
    """Tables bucketed by row in the shared folder, known to the catalog as long as they are needed."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.buckets, self.names = df.sparkSession, buckets, []
        self.folder = f"{shared_folder(df.sparkSession).rstrip('/')}/codes-{uuid.uuid4()}"

    def write(self, df: DataFrame) -> DataFrame:
        name = f"codes_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "row").sortBy("row").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def vector_codes(
    df: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", watch: Callable[[int, int], None] | None = None
) -> DataFrame:
    """Per usable row: vec_id, code, error, its label's error and the digest of the codebooks.

    entries: of each codebook, 256 at most. watch: is told of each round the parts whose assignment changed, and all parts.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code holds 1 to 256 entries")
    spark = df.sparkSession
    schema = f"vec_id {df.schema[vec_id].dataType.simpleString()}, label {df.schema[label].dataType.simpleString()}, code string, error long"
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(usable(F.col("v"))).withColumn("x", scaled(F.col("v"), SCALE)).drop("v")
    n, width, low, high = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n:
        return spark.createDataFrame([], schema).selectExpr("vec_id", "code", "error", "CAST(NULL AS long) AS label_error", "CAST(NULL AS string) AS codebooks_sha256")
    width = max(PARTS, -(-width // PARTS) * PARTS)
    most, m = max(abs(low or 0), abs(high or 0)), width // PARTS
    rows = rows.withColumn("x", padded(F.col("x"), width))
    buckets = min(50_000, max(2 * spark.sparkContext.defaultParallelism, n * width // BUCKET_VALUES))
    tables = _Tables(df, buckets)
    try:
        points = tables.write(rows.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row"))
        first = np.array([r.x for r in points.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()], dtype=np.int64)
        books = [first[:, p * m : p * m + m].copy() for p in range(PARTS)]
        sums = [np.zeros((len(first), m), dtype=object) for _ in range(PARTS)]
        counts = np.zeros((PARTS, len(first)), dtype=object)
        codes = before = None
        for _ in range(rounds):
            before = codes
            joined = points.select("row", "x")
            if codes is not None:
                joined = joined.join(codes.select("row", "codes").hint("merge"), "row")
            step = _round(width, books, most, codes is None)
            codes = tables.write(joined.mapInArrow(step, f"row long, codes binary, delta {_DELTA}"))
            changes = codes.filter("delta IS NOT NULL").select(F.explode("delta").alias("d")).select("d.*")
            added = changes.groupBy("part", "entry").agg(F.sum("count").alias("n")).collect()
            moved = changes.select("part", "entry", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("col").alias("v")).toArrow()
            for r in added:
                counts[r.part, r.entry] += r.n
            for p, e, k, v in zip(*(moved.column(c).to_pylist() for c in ("part", "entry", "pos", "v")), strict=True):
                sums[p][e, k] += int(v)
            if watch:
                watch(_changed(codes, before), PARTS * n)
            for p in range(PARTS):
                used = np.flatnonzero(counts[p] > 0)
                books[p][used] = (sums[p][used] // counts[p][used, None]).astype(np.int64)
        found = store(points.select("vec_id", "label", "x").mapInArrow(_coded(width, books, most), schema))
    finally:
        tables.forget()
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    return _with_label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _changed(codes: DataFrame, before: DataFrame | None) -> int:
    """Parts whose assignment is another than before."""
    if before is None:
        return PARTS * codes.count()
    both = codes.select("row", F.hex("codes").alias("new")).join(before.select("row", F.hex("codes").alias("old")), "row")
    return both.select(sum((F.substring("new", 2 * p + 1, 2) != F.substring("old", 2 * p + 1, 2)).cast("int") for p in range(PARTS)).alias("c")).agg(F.sum("c")).first()[0]


def _with_label_errors(found: DataFrame) -> DataFrame:
    """With the errors' sum over rows of the same label; sums are broadcast up to LABELS, and joined beyond, hot labels salted."""
    keyed = found.withColumn("key_", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    sums = keyed.groupBy("key_").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    if sums.count() <= LABELS:
        return keyed.join(F.broadcast(sums), "key_")
    return salted_join(keyed, sums, "key_", "vec_id")
