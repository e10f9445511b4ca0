"""Shared text helpers: whole texts are cut into words and hashed batch by batch with numpy.

Conventions of every operator here: a null text counts as the empty text; tables are read by column
name, so further columns (even with names an operator uses for its output) never disturb it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are hashed at a time; a longer word or text is still taken whole.
SLICE_BYTES = 1 << 20

#: Rows of a batch that goes to Python.
BATCH_ROWS = 1000

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 2**64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LANES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
#: True for the bytes of a word: all but the six ASCII white-space bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: True for digits, lower-case letters and bytes of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task and its Python worker hold of an exchange at a time; an application's own smaller bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def doc_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """1, base, base**2, ... modulo 2**64."""
    have = cache.get(base)
    if have is None or len(have) < n:
        n = max(n, SLICE_BYTES + 1)
        have = np.empty(n, dtype=np.uint64)
        have[0] = 1
        size = 1
        while size < n:
            step = min(size, n - size)
            have[size : size + step] = have[:step] * np.uint64(pow(base, size, 2**64))
            size += step
        if n <= 4 * SLICE_BYTES:
            cache[base] = have
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, end to end, and where each begins (one more entry for the end)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most limit bytes together, or one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a run of texts: their hashes, byte ranges in data, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_SPACE, prefixes: tuple[int, ...] = ()):
        """data: bytes, lower-cased. keep: which bytes belong to words. prefixes: also hash so many leading bytes."""
        inside = keep[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts_doc = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[starts_doc] = inside[starts_doc]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends_doc = starts_doc[1:] - 1 if len(starts_doc) else starts_doc
        last[ends_doc] = inside[ends_doc]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes, self.prefixes = range_hashes(data, self.starts, self.ends, prefixes)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Hashes of byte ranges that ascend and don't overlap, and of their first n bytes for each n (0 where they are shorter)."""
    out = np.empty(len(starts), dtype=np.uint64)
    leads = {n: np.zeros(len(starts), dtype=np.uint64) for n in prefixes}
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, side="right")))
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        part = data[starts[a] : ends[b - 1]]
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _powers(len(part), _BASE)[: len(part)], out=sums[1:])
        back = _powers(len(part), _BASE_INV)[s]
        out[a:b] = mix((sums[e] - sums[s]) * back + (e - s).astype(np.uint64))
        for n, lead in leads.items():
            at = np.minimum(s + n, e)
            lead[a:b] = np.where(e - s >= n, mix((sums[at] - sums[s]) * back + np.uint64(n) * _LANES[63]), np.uint64(0))
        a = b
    return out, leads


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words of each text, a shorter text's words as one run; and each text's first run."""
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    if len(hashes) >= size:
        rolled = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
        for j in range(size):
            rolled += hashes[j : len(hashes) - size + 1 + j] * _LANES[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    long = n >= size
    pos = np.repeat(first[:-1][long] - at[:-1][long], counts[long])
    out = np.empty(at[-1], dtype=np.uint64)
    where = np.repeat(long, counts)
    index = np.flatnonzero(where)
    out[index] = rolled[index + pos]
    for i in np.flatnonzero((n > 0) & ~long):
        out[at[i]] = mix(np.array([(hashes[first[i] : first[i + 1]] * _LANES[8 : 8 + n[i]]).sum() + np.uint64(n[i])], dtype=np.uint64))[0]
    return out, at


def short_runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, as shingles() hashes a text of n words that is shorter than its size."""
    out = np.full(max(0, len(hashes) - n + 1), n, dtype=np.uint64)
    for j in range(n):
        out += hashes[j : len(out) + j] * _LANES[8 + j]
    return mix(out)


def distinct_per_row(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts each row's values and drops its repeats."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, rows))
    values = values[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=len(at) - 1))])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of its own only where none is set, as in tests."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stage_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, for the tables of one run."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/stages-{uuid.uuid4()}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it again: a cut of the lineage that is compressed and that projections read in part."""
    import uuid

    where = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


#: Keys that may be salted, the rows from which a key is, and the most parts it is dealt to.
HOT_KEYS, HOT_ROWS, SALTS = 500, 200, 64


def hot_keys(left: DataFrame, key: str, least: int = HOT_ROWS) -> list[tuple]:
    """The HOT_KEYS most common keys, as far as they have least rows, with their rows. A key with 1 / HOT_KEYS of all rows is always among them."""
    top = left.groupBy(key).count().filter(F.col("count") >= least).orderBy(F.desc("count"), key).limit(HOT_KEYS)
    return [tuple(r) for r in top.collect() if r[0] is not None]


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """An equi-join on key in which left rows of hot keys are dealt by a hash of spread too, and their right rows copied to each part."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    kind = left.schema[key].dataType.simpleString()
    rows = [(k, min(SALTS, -(-n // HOT_ROWS))) for k, n in hot]
    parts = F.broadcast(left.sparkSession.createDataFrame(rows, f"{key} {kind}, parts_ int"))  # at most HOT_KEYS rows
    some = F.coalesce("parts_", F.lit(1))
    salted = left.join(parts, key, "left").withColumn("salt_", F.pmod(F.xxhash64(spread), some).cast("int")).drop("parts_")
    copied = right.join(parts, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), some - 1))).drop("parts_")
    return salted.join(copied, [key, "salt_"], how).drop("salt_")


def rolling(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n items from each start on."""
    sums = np.empty(len(hashes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(hashes * _powers(len(hashes), _BASE)[: len(hashes)], out=sums[1:])
    return mix((sums[starts + n] - sums[starts]) * _powers(len(hashes), _BASE_INV)[starts])
