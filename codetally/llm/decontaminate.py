"""Benchmark items inside documents, found by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.llm.storage import stage

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
# Seed of the hash that orders the shingles of an item for its MinHash sketch.
SKETCH_SEED = 9
# What stands between words: ASCII characters other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def shingles(text: Column, words: int) -> Column:
    """An array of all runs of ``words`` words of a text, lower-cased, spaces between them.

    Words are runs of letters and digits, anything beyond ASCII included. A
    look-ahead at each word captures the run that starts there, so that runs
    overlap and one regular expression goes over the whole text.
    """
    words_ahead = " ".join(["[^ ]++"] * words)
    run = rf"(?=({words_ahead}))[^ ]++(?: |$)"
    return F.regexp_extract_all(_folded(text), F.lit(run), 1)


def _folded(text: Column) -> Column:
    """Lower-cased words with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, " "))


def item_shingles(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id, length, shingle, n_item``: the distinct shingles of each item.

    An item of fewer than five words is one shingle of all its words (``length``
    of them); an item without words, or with a null id, has none.
    """
    folded = _folded(F.col(text_col))
    n_words = F.when(folded == "", 0).otherwise(F.size(F.split(folded, " ")))
    full = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), F.col(text_col).alias("text"), folded.alias("folded"),
        n_words.alias("n_words"),
    )
    short = F.col("n_words") < SHINGLE_WORDS
    one = full.where(short & (F.col("n_words") > 0)).select(
        "item_id", F.col("n_words").alias("length"), F.col("folded").alias("shingle")
    )
    many = full.where(~short).select(
        "item_id", F.lit(SHINGLE_WORDS).alias("length"),
        F.explode(shingles(F.col("text"), SHINGLE_WORDS)).alias("shingle"),
    )
    distinct = one.unionByName(many).distinct()
    sizes = distinct.groupBy("item_id", "length").agg(F.count("*").alias("n_item"))
    return distinct.join(sizes, ["item_id", "length"])


def containment_sketches(items: DataFrame) -> DataFrame:
    """``item_id, length, shingle`` of each item's MinHash sketch.

    Items are partitioned by size: class c holds those of 2^c to 2^(c+1) - 1
    shingles. The sketch of an item is the shingles with its s smallest hashes. A
    document with a share of 0.8 of the item's n shingles misses n - ceil(0.8 n) of
    them at most, so one more always meets it; s is that number for the largest
    size in the class. Unlike with a fixed number of hash functions no containment
    of 0.8 or more is missed, and a document's length does not matter: its shingles
    probe the sketches, and no sketch of the document is needed.
    """
    size_class = F.floor(F.log2("n_item")).cast("int")
    largest = F.pow(F.lit(2.0), size_class + 1) - 1
    sketch = largest - F.ceil(F.lit(MIN_CONTAINMENT) * largest) + 1
    order = F.xxhash64(F.lit(SKETCH_SEED), "shingle")
    ranked = items.groupBy("item_id", "length", "n_item").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("h"), "shingle"))).alias("hashed")
    )
    return ranked.select(
        "item_id", "length",
        F.explode(F.slice("hashed", F.lit(1), F.greatest(sketch.cast("int"), F.lit(1)))).alias("s"),
    ).select("item_id", "length", "s.shingle")


def _document_shingles(docs: DataFrame, id_col: str, text_col: str, lengths: list[int]) -> DataFrame:
    parts = [
        docs.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("doc"), F.lit(n).alias("length"),
            F.explode(shingles(F.col(text_col), n)).alias("shingle"),
        )
        for n in lengths
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id_col, item_id, n_item, n_shared, containment`` of items found in documents.

    One row for each document and item with at least 0.8 of the item's distinct
    five-word shingles in the document, wherever they stand. Items of fewer than
    five words must occur as a whole. Null texts are empty. Rows without an id, of
    either table, and items without words match nothing; rows with the same id
    count as one document or item. Empty tables give an empty table. Extra columns
    are not read.

    Sketches, shingles and candidates are written tables whose size Spark knows:
    it broadcasts them up to its own threshold and joins by key beyond it. Documents
    that meet no sketch are not looked at again. An item that very many documents
    contain gives a row for each of them.
    """
    all_items = stage(item_shingles(items, item_col, item_text_col), "item-shingles")
    lengths = sorted(r[0] for r in all_items.select("length").distinct().collect())  # 1 to 5
    if not lengths:
        lengths = [SHINGLE_WORDS]
    sketches = stage(containment_sketches(all_items), "item-sketches")
    runs = _document_shingles(docs, id_col, text_col, lengths)
    candidates = stage(
        runs.join(sketches, ["length", "shingle"]).select("doc", "item_id").distinct(), "candidates"
    )
    met = docs.join(
        candidates.select(F.col("doc").alias(id_col)).distinct(), id_col, "left_semi"
    )
    shared = (
        _document_shingles(met, id_col, text_col, lengths)
        .join(all_items, ["length", "shingle"])
        .join(candidates, ["doc", "item_id"], "left_semi")
        .groupBy("doc", "item_id", "n_item", "length")
        .agg(F.count_distinct("shingle").alias("n_shared"))
    )
    return shared.where(F.col("n_shared") >= MIN_CONTAINMENT * F.col("n_item")).select(
        F.col("doc").alias(id_col), "item_id", "n_item", "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """``docs`` without those that contain an item; rows with a null id stay."""
    found = stage(contained_items(docs, items, id_col, **columns).select(id_col).distinct(), "contaminated")
    return docs.join(found, id_col, "left_anti")
