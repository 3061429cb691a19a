"""The queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import clusters, ctw, decontaminate, embeddings, jaccard, langid, licenses, mixing, pii, runindex, secrets, tries, urls
from halocline.llm.sql import CLUSTERS_SQL, EMBEDDINGS_SQL, JACCARD_SQL, LICENSE_SQL, PII_SQL, REPEATS_SQL, SECRETS_SQL, TRIES_SQL, URLS_SQL
from halocline.llm.workspace import table

RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
#: Domains that the cascade blocks where no rule fits.
LISTED = [f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ctw.score(docs, ~in_fold(F.col("doc_id"), 10))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_similar(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def op4_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[c.alias(k) for k, c in secrets.digest_columns(F.col("secret_spans"), secrets.KINDS).items()])


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.rows_of_mix(mixing.mix(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def in_fold(doc_id, folds: int):
    """Whether the crc32 of the id's text falls on 0; a null id is in the fold, so that nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", in_fold(F.col("doc_id"), 5).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    found = langid.predict(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op7_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    name = F.array(*[F.lit(k) for k in pii.KINDS])

    def joined(xs):
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [secrets.count_kind(spans, i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.filter(spans, lambda x: x["kind"] < pii.BASE)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",").alias("scores_percent"),
    )


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).drop("text_key")


def op11_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return clusters.sort_means(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 8, 10, 64, drawn)


def op13_prefix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree_weighting": op1_context_tree_weighting,
    "op2_license_digests": op2_license_digests,
    "op3_chosen_path_join": op3_chosen_path_join,
    "op4_secret_entropy": op4_secret_entropy,
    "op5_pivotal_mix": op5_pivotal_mix,
    "op6_language_bitmask": op6_language_bitmask,
    "op7_pivot_permutations": op7_pivot_permutations,
    "op8_url_cascade": op8_url_cascade,
    "op9_pii": op9_pii,
    "op10_latent_decontamination": op10_latent_decontamination,
    "op11_run_length_index": op11_run_length_index,
    "op12_sort_means": op12_sort_means,
    "op13_prefix_tries": op13_prefix_tries,
}
ORACLE: dict[str, str] = {
    "op2_license_digests": LICENSE_SQL,
    "op3_chosen_path_join": JACCARD_SQL,
    "op4_secret_entropy": SECRETS_SQL,
    "op7_pivot_permutations": EMBEDDINGS_SQL,
    "op8_url_cascade": URLS_SQL,
    "op9_pii": PII_SQL,
    "op11_run_length_index": REPEATS_SQL,
    "op12_sort_means": CLUSTERS_SQL,
    "op13_prefix_tries": TRIES_SQL,
}
