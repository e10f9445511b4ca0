"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, decontam, jaccard_join, license_scan, lm_score, media, mixing, secret_scan, sharding, substring_dedup, toxicity, vector_codes, whitening
from touchline.llm.common import doc_crc, small_batches, stage_folder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (F.pmod(doc_crc(), F.lit(4)) == 2).alias("held_out"), "score", "predicted", "n_tokens", "expected", "spans")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts go through both passes; sizes and checksums are those of the shards as they are read back."""
    shards = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 8, carry=("text",)).drop("size", "text_crc32")
    folder = stage_folder(spark)
    sharding.write_shards(shards, folder)
    return sharding.with_sizes(sharding.read_shards(spark, folder, shards.schema)).drop("text").withColumn("grown_shard", F.lit(None).cast("int"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two deliveries by a hash of the id: the second is met by the ledger that the first one left."""
    docs, first = table(spark, sf_dir, "documents"), F.pmod(doc_crc(), F.lit(2)) == 0
    return secret_scan.scan_deliveries([docs.filter(first), docs.filter(~first)]).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages_and_kept(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_sharding, op3_lm_score, op4_mixing, op5_jaccard_join, op6_license_scan, op7_secret_scan, op8_media, op9_decontamination, op10_substring_dedup, op11_whitening, op12_vector_codes, op13_byte_bpe, pipeline)
    return {q.__name__: _bounded(q) for q in found}


def _codes_sql(rounds: int = 4) -> str:
    """op12_vector_codes round by round: parts of all rows against all entries of their part's codebook, in doubles that hold the integers exactly."""
    near = """SELECT id, part, x, entry, d FROM (SELECT p.id, p.part, p.x, b.entry, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c) + list_inner_product(b.c, b.c) AS d FROM parts p JOIN book{k} b USING (part))
        QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY d, entry) = 1"""
    ctes = {
        "kept": """SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS id, vec_id, label, x FROM (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        "parts": "SELECT id, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS part)",
        "book0": "SELECT part, id - 1 AS entry, x AS c FROM parts WHERE id <= 256",
    }
    for k in range(rounds):
        ctes[f"near{k}"] = near.format(k=k)
        ctes[f"mean{k}"] = f"SELECT part, entry, list(v ORDER BY pos) AS c FROM (SELECT part, entry, pos, floor(sum(v) / count(*)) AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM near{k}) GROUP BY ALL) GROUP BY ALL"
        ctes[f"book{k + 1}"] = f"SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry)"
    ctes["found"] = near.format(k=rounds)
    ctes["sums"] = "SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM found GROUP BY id"
    ctes["digest"] = f"SELECT sha256(string_agg(array_to_string(CAST(c AS BIGINT[]), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}"
    return f"WITH {', '.join(f'{k} AS MATERIALIZED ({v})' for k, v in ctes.items())} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM sums JOIN kept USING (id), digest"


def oracle_sql() -> dict[str, str]:
    return {"op12_vector_codes": _codes_sql()}
