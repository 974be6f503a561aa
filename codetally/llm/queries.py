"""One query per operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm import (
    decontaminate,
    gnat,
    hnsw,
    html_content,
    license_rules,
    preferences,
    sentencepiece_codec,
    simhash,
    substring_dedup,
    token_alignment,
    url_filter,
    warc,
    weak_label,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]
# Marks of pages that put their URL on the list.
LISTED_MARKS = r"\*\*\*|%%%|\$\$\$|!!|://[^/]*(casino-win|cheap-pills|free-bets|spam-farm)"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL; listed are the URLs of pages with marks of spam."""
    pages = table(spark, sf_dir, "pages")
    marked = F.col("html").rlike(LISTED_MARKS) | F.col("url").rlike(LISTED_MARKS)
    judged = url_filter.judge_urls(pages.select("page_id", "url"), pages.where(marked), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the capture index."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    return warc.read_back(spark, archive, warc.url_keys(pages))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, paired with a worse version of itself, as prompt and completions."""
    conversations = table(spark, sf_dir, "conversations")
    return preferences.format_preferences(
        conversations, preferences.echoing(conversations), id_col="conv_id"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = license_rules.scan_licenses(docs)
    starts = F.transform("base", lambda b: b["start"])
    base = F.transform("base", lambda b: b["label"])
    every = F.concat(base, F.transform("hits", lambda h: h["label"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        license_rules.confidence(F.col("hits")).alias("score"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, with round trip and parity."""
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op6_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return hnsw.similar_vectors(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, quality_score, kept`` for every document."""
    docs = table(spark, sf_dir, "documents")
    model = weak_label.fit_quality(docs)
    scored = weak_label.score_quality(docs.select("doc_id", "text"), model)
    kept = F.col("quality_score") >= weak_label.THRESHOLD
    return scored.select("doc_id", "quality_score", kept.alias("kept"))


def op8_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_content.extract_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains."""
    return decontaminate.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id"
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that documents before it have."""
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(removed, 0L, (n, span) -> n + span.stop - span.start)").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose id is divisible by 50, some labels moved on by one."""
    moved = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return gnat.mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers for every document, with corpus-wide counts of links."""
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in [
        op1_url_filter,
        op2_warc,
        op3_preferences,
        op4_license_scan,
        op5_sentencepiece,
        op6_similar_vectors,
        op7_quality,
        op8_html_content,
        op9_decontamination,
        op10_simhash,
        op11_substring_dedup,
        op12_hard_negatives,
        op13_token_alignment,
    ]
}
