"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document that holds at least `threshold` of its distinct word shingles (five words, or all
words of a shorter item). An item's signature is its smallest shingle hashes: with n shingles of which `need` must
be shared, any n - need + 1 of them contain a shared one, so no containment is missed however long the document is.
Items are partitioned by size: the size sets how many minimum hashes their signature keeps and the least number of
shingles a document must have. Documents are matched with signatures first; only candidates are verified,
by intersecting the whole shingle sets.

Cases: null and empty texts have no shingles and match nothing, as items too; rows sharing an id are one document or
item whose best row counts (a null id is an id); equal items are all reported; empty tables give an empty result;
other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import SPACE, stored, text_of

WIDTH = 5
BROADCAST_ROWS = 400_000  # rows of two or three longs: at most about 16 MB


def if_small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast when its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words_column: str, width: int) -> Column:
    """Hashes of all runs of `width` words; no runs when there are fewer words."""
    n = F.size(words_column)
    run = lambda i: F.xxhash64(F.lit(width), *[F.col(words_column)[i + k] for k in range(width)])
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - F.lit(width)), run)).otherwise(
        F.array().cast("array<bigint>"))


def item_sets(items: DataFrame, threshold: float) -> DataFrame:
    """item_id, width, hashes (sorted, distinct), need, signature; one row per row of items with words."""
    width = F.least(F.size("w"), F.lit(WIDTH))
    hashes = F.lit(None).cast("array<bigint>")
    for k in range(1, WIDTH + 1):
        hashes = F.when(width == k, shingle_hashes("w", k)).otherwise(hashes)
    return (
        items.select("item_id", words(text_of()).alias("w")).filter("size(w) > 0")
        .select("item_id", width.alias("width"), F.array_sort(F.array_distinct(hashes)).alias("hashes"))
        .withColumn("need", F.ceil(F.size("hashes") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
        .withColumn("size_class", F.floor(F.log2(F.size("hashes"))).cast("int"))
        .withColumn("signature", F.slice("hashes", F.lit(1), F.size("hashes") - F.col("need") + 1))
    )


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment for every item found in a document."""
    sets = stored(item_sets(items, threshold), "decon-items")
    widths = [r[0] for r in sets.select("width").distinct().collect()]  # at most five numbers
    signatures = if_small(stored(
        sets.select("item_id", "size_class", "need", F.explode("signature").alias("hash")), "decon-signatures"))
    tokens = docs.select("doc_id", words(text_of()).alias("w"))
    every = F.concat(*[shingle_hashes("w", k) for k in sorted(widths)]) if widths else F.array().cast("array<bigint>")
    # explode would infer a filter on the hashes, pushed down to where each lambda call splits the text anew
    hits = (
        tokens.select("doc_id", every.alias("h")).select("doc_id", F.size("h").alias("n_doc"), F.explode_outer("h").alias("hash"))
        .join(signatures, "hash").filter("n_doc >= need").select("doc_id", "item_id")
    )
    pairs = stored(hits.distinct().select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item")), "decon-pairs")

    # exact sets of candidates only
    wanted = if_small(stored(pairs.groupBy("_doc").agg(F.count("*").alias("n_items")), "decon-wanted"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    found = texts.select("doc_id", words(text_of()).alias("w"))
    found = found.select("doc_id", F.array_distinct(every).alias("h")).join(
        if_small(pairs), F.col("doc_id").eqNullSafe(F.col("_doc")))
    both = found.join(if_small(sets), F.col("item_id").eqNullSafe(F.col("_item")))
    shared = F.size(F.array_intersect("h", "hashes"))
    return (
        both.select("doc_id", "item_id", "need", F.size("hashes").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
        .filter("n_shared >= need")
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("n_shingles", "n_shared"), F.col("n_shared") / F.col("n_shingles")).alias("b"))
        .select("doc_id", "item_id", "b.n_shingles", "b.n_shared", (F.col("b.n_shared") / F.col("b.n_shingles")).alias("containment"))
    )


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs without the documents in which an item is found; same columns."""
    bad = if_small(stored(contained_items(docs, items, threshold).select(F.col("doc_id").alias("_doc")).distinct(), "decon-bad"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
