"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.llm import (
    decontaminate,
    licenses,
    linededup,
    ngramjoin,
    packing,
    periodic,
    pii,
    quality,
    secrets,
    simhash,
    topk,
    toxicity,
    whitening,
)
from rulespan.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


def op2_pii_scan(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents")).drop("base", "added")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.join(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    # The rank file holds the vocabulary of byte_bpe_50k.json; tests hold both to the same ids.
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_toxicity_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.col("row.text").alias("text"))


def op8_bit_sliced_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5)


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents")).drop("base", "added")


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), components=4)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The contract's input of op13: every tenth document (by the hash h of its id) repeats a stretch of words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.filter(
        F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("words"))
    sized = words.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rest = F.col("n") - F.col("a")
    period = sized.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    one = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(one, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest.cast("int"))
    return period.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")).otherwise(
        F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find(repeated_tails(table(spark, folder, "documents")))
    # The greatest length, then the smallest start, then the smallest period.
    longest = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    length, period = -F.col("best.n"), F.col("best.p")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES["op2_pii_scan"] = op2_pii_scan
QUERIES["op3_decontamination"] = op3_decontamination
QUERIES["op4_ngram_join"] = op4_ngram_join
QUERIES["op5_packing"] = op5_packing
QUERIES["op6_quality_classifier"] = op6_quality_classifier
QUERIES["op10_toxicity_classifier"] = op10_toxicity_classifier
QUERIES["op7_line_dedup"] = op7_line_dedup
QUERIES["op8_bit_sliced_topk"] = op8_bit_sliced_topk
QUERIES["op9_secret_scan"] = op9_secret_scan
QUERIES["op11_simhash"] = op11_simhash
QUERIES["op12_whitening"] = op12_whitening
QUERIES["op13_periodic_runs"] = op13_periodic_runs
SQL["op8_bit_sliced_topk"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
        list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5"""
QUERIES["op1_license_scan"] = op1_license_scan
SQL["op1_license_scan"] = licenses.digest_sql()
