"""Two-pass external shuffle into equal shards, in DataFrame operations only.

Pass 1 scatters the records uniformly over buckets small enough for memory, by a seeded hash of id and
content; repeated rows, which have one hash, are counted first and dealt by their number, so that no bucket is theirs
alone. Pass 2 reads one bucket at a time, brings its records into a fixed order and applies a seeded
Fisher-Yates shuffle (Spark's ``shuffle`` function). The buckets one after another are the shuffled
sequence; its position p goes to shard ``p mod n``, slot ``p div n``, so that shards differ by one row at
most (law ``rows``) and the slots of a shard run from 0 without gaps.

Defined results: null ids and null texts are records like others (size 1, crc32 of nothing); repeated rows
stay repeated, each with its own slot; an empty table gives no rows; other columns are carried only if named.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes that a bucket should hold; it is one array in memory in pass 2.
BUCKET_ROWS, BUCKET_BYTES = 1024, 8 << 20
#: Buckets in a partition of pass 2, and partitions at most.
PART_BUCKETS, MAX_PARTS = 8, 50_000
#: Hashes with more than a bucket's rows that are dealt by number, the most common first (8 bytes each in a broadcast); any
#: further one has less than one in HOT_HASHES of all rows.
HOT_HASHES, COPIES = 100_000, 4096
#: Buckets whose sizes one window task adds up.
SUPER = 1024


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size (UTF-8 bytes plus 1) and text_crc32."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"size": F.octet_length(raw).cast("long") + 1, "text_crc32": F.crc32(raw)})


def bucket_offsets(records: DataFrame) -> DataFrame:
    """(bucket, start): records in all buckets before. Sums run within blocks of SUPER buckets, then over blocks."""
    counts = records.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / SUPER))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("all_n")).select("block", F.coalesce(F.sum("all_n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, "block").select("bucket", (F.col("base") + F.col("inner")).alias("start"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Repeated rows, which are alike in every column, with numbers from 0 (copy): counted before the exchange and told out again after it."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    lots = counts.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    own = F.sequence(F.col("lot") * COPIES, F.least(F.col("n"), (F.col("lot") + 1) * COPIES) - 1)
    return lots.repartition("h", "lot").select(*rows.columns, F.explode(own).alias("copy"))


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per record: id, size, text_crc32, law, shard, slot, and the columns in carry (name text_col there to carry texts)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    own = {f"c{i}": F.col(c) for i, c in enumerate(carry)}
    flat = with_sizes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in own.items()]))
    total = flat.agg(F.count("*").alias("n"), F.sum(F.col("size") if text_col in carry else F.lit(0)).alias("bytes")).first()
    buckets = max(1, math.ceil(max(total["n"] / bucket_rows, (total["bytes"] or 0) / bucket_bytes)))
    order = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    hashed = flat.select(order.alias("h"), "doc_id", "size", "text_crc32", *own)
    often = [r["h"] for r in hashed.groupBy("h").count().filter(F.col("count") > bucket_rows).orderBy(F.desc("count"), "h").limit(HOT_HASHES).collect()]
    records = hashed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    if often:
        hot = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in often], "h long"))  # at most HOT_HASHES rows
        records = records.join(hot, "h", "left_anti").unionByName(_numbered(hashed.join(hot, "h", "left_semi")).withColumn("bucket", F.pmod(F.xxhash64("h", "copy"), F.lit(buckets))).drop("copy"))
    # Spark draws the numbers of a task's shuffles from one generator per partition; so which buckets a partition holds, and
    # in which order, is fixed by the data alone, and a task that runs again gives the same rows
    parts = min(MAX_PARTS, -(-buckets // PART_BUCKETS))
    gathered = records.repartition(parts, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "size", "text_crc32", *own))).alias("records"))
    shuffled = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    at = F.col("start") + F.col("pos")
    return (
        shuffled.join(bucket_offsets(records), "bucket")
        .select("start", F.posexplode("records").alias("pos", "r"))
        .select(
            F.col("r.doc_id").alias(id_col), F.col("r.size").alias("size"), F.col("r.text_crc32").alias("text_crc32"), F.lit("rows").alias("law"),
            F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"), F.floor(at / n_shards).cast("long").alias("slot"), *[F.col(f"r.{k}").alias(c) for k, c in zip(own, carry, strict=True)],
        )
    )


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder per shard; each task's rows of a shard are a file sorted by slot, with no further exchange."""
    shards.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
