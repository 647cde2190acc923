"""Vector code compression: product quantisation in whole numbers.

Components become whole numbers and vectors are cut into parts; every part position has a codebook of a few entries.
Distances to the entries come from exact products: numbers are broken into limbs whose products double precision
multiplies without loss, dot products are put together as 64-bit integers, and the first least distance wins. So codes
and codebooks do not depend on the order of rows or on how they are split.

Each round is one pass over the stored whole numbers: tasks sum the parts they assign by codebook entry, Spark adds
these sums, and only the codebooks (parts x entries x width numbers) pass through the driver.

Cases: vectors that are null or hold null or non-finite components are left out; so are vectors of another length than
the first's (smallest id, then vector, then label; null ids last). Lengths that are no multiple of the number of parts
are filled up with zeros, which changes no distance. With fewer vectors than entries a codebook has one entry for each.
Repeated rows are vectors of their own. Very large components saturate (see `whole.quantised`), sums beyond a long
become the largest long. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import stored
from vigilark.llm.decontaminate import if_small
from vigilark.llm.whole import products, quantised, sound

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SLICE = 2048
LONGEST = (1 << 63) - 1


def cut(rows: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width) of lists of one length, filled up with zeros."""
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(rows), len(flat) // max(1, len(rows)))
    filled = np.zeros((len(rows), parts * width), np.int64)
    filled[:, :x.shape[1]] = x
    return filled.reshape(len(rows), parts, width)


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the first nearest entry for each row and part."""
    index = np.zeros(x.shape[:2], np.int64)
    distance = np.zeros(x.shape[:2], np.int64)
    for p, entries in enumerate(codebooks):
        own = np.ascontiguousarray(x[:, p])
        apart = (own * own).sum(1)[:, None] - 2 * products(own, entries) + (entries * entries).sum(1)
        index[:, p] = apart.argmin(1)
        distance[:, p] = apart[np.arange(len(own)), index[:, p]]
    return index, distance


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _sums(codebooks: np.ndarray):
    """Sums and counts (position -1) of the parts assigned to each entry, once per task."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width), np.int64)
        count = np.zeros(parts * entries, np.int64)
        for batch in _slices(batches):
            x = cut(batch.column("vector"), parts, width)
            slot = nearest(x, codebooks)[0] + np.arange(parts) * entries
            np.add.at(total, slot.reshape(-1), x.reshape(slot.size, width))
            count += np.bincount(slot.reshape(-1), minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(np.repeat(used, width + 1)), "position": pa.array(np.tile(np.arange(-1, width), len(used))),
            "total": pa.array(np.hstack([count[used, None], total[used]]).reshape(-1))})

    return run


def _coded(codebooks: np.ndarray):
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            index, distance = nearest(cut(batch.column("vector"), parts, width), codebooks)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"),
                "code": pa.array([row.tobytes().hex() for row in index.astype(np.uint8)], pa.string()),
                "error": pa.array(distance.sum(1))})

    return run


def refined(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts assigned to them; unused entries stay."""
    _, entries, _ = codebooks.shape
    sums = vectors.select("vector").mapInArrow(_sums(codebooks), "slot long, position long, total long").groupBy("slot", "position").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {(r["slot"], r["position"]): int(r["total"]) for r in sums.collect()}  # parts * entries * (width + 1) rows at most
    out = codebooks.copy()
    for (slot, position), total in found.items():
        if position >= 0:
            out[slot // entries, slot % entries, position] = total // found[slot, -1]
    return out


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error for each vector, codebooks) of `vectors` (vec_id, embedding, label).

    `code` has two hex digits a part, so at most 256 entries; label_error sums the errors of equal labels, nulls
    together.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code holds indexes below 256")
    kept = stored(
        vectors.filter(sound(F.col("embedding"))).select("vec_id", "label", quantised(F.col("embedding"), scale).alias("vector")),
        "codes-vectors")
    order = [F.col("vec_id").asc_nulls_last(), "vector", "label"]
    first = kept.orderBy(*order).limit(1).select(F.size("vector")).collect()
    length = first[0][0] if first else 0
    kept = kept.filter(F.size("vector") == length)
    start = [r["vector"] for r in kept.orderBy(*order).limit(entries).collect()]  # one row per entry
    width = -(-length // parts)
    rows = pa.array(start, pa.list_(pa.int64()))
    codebooks = np.ascontiguousarray(cut(rows, parts, width).transpose(1, 0, 2)) if start else np.zeros((parts, 1, 0), np.int64)
    for _ in range(rounds):
        codebooks = refined(kept, codebooks)
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    coded = stored(kept.mapInArrow(_coded(codebooks), schema), "codes-coded")
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    totals = stored(coded.groupBy(F.col("label").alias("_label")).agg(whole.alias("label_error")), "codes-labels")
    return coded.join(if_small(totals), F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), codebooks
