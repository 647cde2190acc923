"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark.session import stored

SPACE = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fingerprint(column: Column) -> Column:
    """128-bit key of a string, as 32 hex digits."""
    return F.md5(column.cast("binary"))


def unit_hash(seed: str, *columns: str) -> Column:
    """Reproducible draw in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def ranked(df: DataFrame, group: list[str], spread: Column, n_buckets: int, order: list, name: str = "rank") -> DataFrame:
    """0-based rank inside `group`, gapless, without one task per group.

    Rows are dealt over `n_buckets` by `spread`; a small table of bucket sizes gives every bucket
    its first rank and rows are numbered inside their bucket only. `df` must be a stored table,
    as it is read twice.
    """
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(n_buckets)).cast("int"))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (
        numbered.join(first, same, "left").withColumn(name, F.col("_first") + F.col("_in"))
        .drop("_bucket", "_in", "_first", *[f"_k{i}" for i in range(len(keys))])
    )


def components(spark: SparkSession, edges: DataFrame, purpose: str) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches.

    Alternates star contractions: every id points the larger of its neighbours, then the smaller ones,
    at the least of them, until only stars are left. Each round is a written table; the number of rounds grows with
    the logarithm of the longest chain. `edges` has columns a, b; ids without an edge are not returned.
    """
    both = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    now = stored(edges.filter("a <> b").select(*both).distinct(), purpose)
    while not _are_stars(now):
        turned = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = turned.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = turned.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = stored(larger.filter("lo <> hi").distinct(), purpose)
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        now = stored(
            small.select(F.col("m").alias("lo"), "hi").unionByName(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
            .filter("lo <> hi").distinct(), purpose)
    tree = now.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("id"), "component")
    return tree.unionByName(tree.select(F.col("component").alias("id"), "component").distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every larger id has one smaller id, which is no larger id itself."""
    ends = pairs.select(F.col("lo").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(
        pairs.select(F.col("hi").alias("id"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    per_id = ends.groupBy("id").agg(F.max("low").alias("low"), F.sum("high").alias("high"))
    return not per_id.agg(F.coalesce(F.bool_or(F.expr("low + high > 1")), F.lit(False))).first()[0]


# ---- text in tasks -------------------------------------------------------------------------------


def pieces(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows whose texts hold about `most_bytes`; a longer text stands alone, whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word ids, distinct words, first word of each row and the end): runs of other bytes than ASCII white space.

    `lower` changes A-Z only. Null texts have no words.
    """
    data, at = bytes_of(texts)
    inside = ~((data == 32) | (data - np.uint8(9) < 5))
    fresh = np.ones(len(data) + 1, bool)  # a row or a white space ends before this byte
    fresh[1:-1] = ~inside[:-1]
    fresh[at] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    ends = np.flatnonzero(inside & (fresh[1:] | ~np.append(inside[1:], False))) + 1
    letters = data[inside]
    if lower:
        letters = letters + ((letters - np.uint8(65) < 26).astype(np.uint8) << 5)
    places = np.append(0, np.cumsum(ends - starts))
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(letters))
    coded = flat.dictionary_encode()
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary,
            np.searchsorted(starts, at).astype(np.int64))


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all strings in a row, first byte of each and the end); nulls count as empty."""
    strings = pc.fill_null(strings.cast(pa.large_binary()), b"")
    _, places, data = strings.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[strings.offset:strings.offset + len(strings) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser on uint64 arrays; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string from its bytes and their places."""
    data, offsets = bytes_of(strings)
    lengths = np.diff(offsets)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
    terms = mixed((place.astype(np.uint64) << np.uint64(8)) + data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mixed(total[offsets[1:]] - total[offsets[:-1]] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each start, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups from rows sorted by `keys`: (rows, first row of each group and the end), a few groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(rows, keys)
        if starts[-2] > 0:
            yield rows.slice(0, int(starts[-2])), starts[:-1]
            rest = rows.slice(int(starts[-2])).combine_chunks()
            held = rest.to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, group_starts(rows, keys)


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)
