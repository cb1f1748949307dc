"""The queries of the corpus operators, each over its whole table."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, exact_dedup, importance, line_dedup, mixing, prefix_trie, secrets, simhash, token_counts, url_filters
from . import quality as quality_model
from . import toxicity as toxicity_model
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs, quality=table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_model.toxicity(docs, table(spark, sf_dir, "labels"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, _ in secrets.KINDS), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.quality(docs, table(spark, sf_dir, "labels"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(rows)))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, turn, role, chat_format.PLANTED) for turn, role in enumerate(("user", "assistant"))], rows.schema)
    out = chat_format.chat_format(chat_format.from_rows(rows.unionByName(planted)))
    out = out.select("conv_id", "formatted", chat_format.turns_in(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    count = lambda c: c.cast("long")
    return out.select("conv_id", count(F.size("turns")).alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), count(F.char_length("loss")).alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), count(F.char_length("formatted")).alias("formatted_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_mixing, op3_exact_dedup, op4_decontamination, op5_toxicity, op6_secret_scans, op7_line_dedup, op8_token_counts, op9_simhash, op10_quality, op11_importance, op12_prefix_trie, op13_chat_format)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filters.oracle(), "op2_mixing": mixing.oracle(), "op3_exact_dedup": exact_dedup.oracle(), "op6_secret_scans": secrets.oracle(), "op11_importance": importance.oracle(), "op12_prefix_trie": prefix_trie.oracle(), "op13_chat_format": chat_format.oracle()}
