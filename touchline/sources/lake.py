"""The Parquet lake of canonical tables: partitioned sinks, corpus scans, views, and the log of what was taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "source string, match_id string, content_hash string, n_rows long, schema_version string, ingested_at timestamp"
SCHEMA_VERSION = "0.1.0"


def write_actions(actions: DataFrame, root: str, competition: str, season: str) -> None:
    """One folder per competition, season and match; matches written again replace their own folders only."""
    _write(actions, f"{root}/events", competition, season, ["match_id"])


def write_tracking(tracking: DataFrame, root: str, competition: str, season: str) -> None:
    """One folder per competition, season, match and period."""
    _write(tracking, f"{root}/tracking", competition, season, ["match_id", "period"])


def _write(rows: DataFrame, path: str, competition: str, season: str, keys: list[str]) -> None:
    named = rows.withColumns({"competition": F.lit(competition), "season": F.lit(season)})
    # one exchange, so that each folder is written by the tasks of its key and not by all
    named.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("competition", "season", *keys).parquet(path)


def read_corpus(spark: SparkSession, root: str, kind: str = "events", match_ids: list[str] | None = None, min_rows: int = 0) -> DataFrame:
    """The table of all matches, or of some (their folders alone are listed); matches with fewer than min_rows rows are left out.

    Counting is one aggregate a match, joined back; no pass a match.
    """
    rows = spark.read.option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}").withColumn("match_id", F.col("match_id").cast("string"))
    rows = rows if match_ids is None else rows.filter(F.col("match_id").isin(*match_ids))
    if not min_rows:
        return rows
    many = rows.groupBy("match_id").count().filter(F.col("count") >= min_rows).select("match_id")
    return rows.join(many, "match_id", "left_semi")


def register_views(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("events", "tracking")) -> list[str]:
    """Temporary views of the tables that the lake has; a table without files has none."""
    from pyspark.errors import AnalysisException

    out = []
    for kind in kinds:
        try:
            read_corpus(spark, root, kind).createOrReplaceTempView(kind)
            out.append(kind)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return out


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, content_hash): the first 16 hexadecimal digits of each file's SHA-256."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))


def record_ingest(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Appends to the log; a later row of a source and match stands for the earlier ones when it is read, so no file is rewritten."""
    rows.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in LOG_SCHEMA.split(", ")]).write.mode("append").parquet(f"{root}/ingest_log")


def ingest_log(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """The latest row of each source and match, newest first."""
    rows = spark.read.schema(LOG_SCHEMA).parquet(f"{root}/ingest_log")
    rows = rows if source is None else rows.filter(F.col("source") == source)
    latest = F.row_number().over(Window.partitionBy("source", "match_id").orderBy(F.desc("ingested_at"), F.desc("content_hash")))
    return rows.withColumn("k_", latest).filter("k_ = 1").drop("k_").orderBy(F.desc("ingested_at"), "source", "match_id")


def inputs_hash(spark: SparkSession, path: str) -> str:
    """One hash of all input files' paths, sizes and times of change; files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.concat_ws("|", "path", "length", F.col("modificationTime").cast("long")).alias("f"))
    # a sum of hashes, so that no task gathers all files
    got = files.agg(F.sum(F.xxhash64("f").cast("decimal(38,0)")), F.count("*")).first()
    import hashlib

    return hashlib.sha256(f"{got[0]}|{got[1]}".encode()).hexdigest()


def write_cache(tables: dict[str, DataFrame], path: str, version: str, inputs: str) -> None:
    """Tables and, once they stand, the manifest that makes them valid."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, inputs, sorted(tables))], "version string, inputs string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_cache(spark: SparkSession, path: str, version: str, inputs: str) -> dict[str, DataFrame] | None:
    """The cached tables if the manifest is of this version and these inputs."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("version string, inputs string, tables array<string>").json(f"{path}/manifest").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if row is None or (row["version"], row["inputs"]) != (version, inputs):
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in row["tables"]}
