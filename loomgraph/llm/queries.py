"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, gif, jaccard_join, language_id, licenses, oracles, packing, prefix_counts, secret_scans, sharding, toxicity, url_filters
from .common import read

#: Token budget that op3 reports on.
LIMIT = 1024


#: Host and path rules; the longest that fits a url decides.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.prefix_counts(read(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.octet_length("prefix_changes").cast("long").alias("n_prefixes"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = gif.text_media(read(spark, sf_dir, "documents"))
    n = F.octet_length("payload")
    return stored.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("gif").cast("long").alias("media_bytes"),
        F.sha2("gif", 256).alias("media_sha256"),
        F.concat_ws(",", F.format_string("frames=%d;ms=%d;grey=", "n_frames", "duration_ms"), F.concat_ws(",", F.col("histogram").cast("array<string>"))).alias("feature"),
    )


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(_fold(4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(_fold(5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def _places(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.expr(_places("filter(spans, s -> s.kind <> 'novel')")), 256).alias("base_sha256"),
        F.expr(_places("spans")).alias("spans"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(read(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_best_fit_packing, op3_token_counts, op4_media_columns, op5_language_id, op6_toxicity, op7_jaccard_join, op8_secret_scans, op9_license_scans, op10_benchmark_decontamination, op11_collocations, op12_sharding)}
#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLES = oracles.ORACLES
