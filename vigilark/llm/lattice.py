"""Embedding near-duplicates by lattice hashing.

A table projects each vector at random to blocks of eight dimensions, scales them and decodes every block to the
nearest point of the E8 lattice; the points of the blocks together are a cell. A vector is filed in its own cell and in
the neighbouring cells it lies closest to, in several tables. Two vectors meet when one's own cell is among the
other's cells; pairs that meet are verified by their cosine in double precision.

Equal vectors are folded into one before hashing. Large cells are cut into blocks, and pairs of blocks are compared in
tasks of bounded size by matrix products; a task returns sums and a spanning forest, never all pairs. A pair that meets
in several tables is counted only in the first.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
different lengths; repeated rows of one id are one vector (the first by value); null ids stay as a vector of their own;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import components, mixed, sorted_groups, stored

TABLES, BLOCKS, PROBES, CELL = 5, 2, 8, 2.0  # recall at a cosine of exactly 0.9: about 0.91; closer pairs: more
TILE = 512


def lattice_points(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight numbers, doubled so that they are whole numbers."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        worst = np.abs(off).argmax(1)
        rows = np.arange(len(y))
        odd = near.sum(1).astype(np.int64) % 2 != 0
        step = np.where(off[rows, worst] < 0, -1.0, 1.0)
        near[rows[odd], worst[odd]] += step[odd]
        return near

    whole, half = even(x), even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype(np.int64)


def neighbours() -> np.ndarray:
    """The 240 shortest E8 vectors, doubled."""
    signs = np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T
    found = [signs[(signs < 0).sum(1) % 2 == 0]]
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = np.zeros((1, 8), np.int64)
                    v[0, i], v[0, j] = a, b
                    found.append(v)
    return np.vstack(found)


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int, cell: float) -> np.ndarray:
    """(rows, tables, 1 + probes) cell numbers of unit vectors: the own cell first, then the closest neighbours."""
    n, dim = unit.shape
    near = neighbours()
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    spread = mixed(np.arange(1, 8 * blocks + 1, dtype=np.uint64)) | np.uint64(1)
    for t in range(tables):
        planes = np.random.default_rng((2024, t, dim)).standard_normal((dim, 8 * blocks))
        offset = np.random.default_rng((7, t)).uniform(0, 2, 8 * blocks)
        x = (unit @ planes) / cell + offset
        points = np.hstack([lattice_points(x[:, 8 * b:8 * b + 8]) for b in range(blocks)])
        salt = mixed(np.array([t + 1], np.uint64))[0]
        plain = (points.astype(np.uint64) * spread).sum(1)
        out[:, t, 0] = mixed(plain + salt)
        gains = np.hstack([(x - points / 2)[:, 8 * b:8 * b + 8] @ near.T for b in range(blocks)])
        best = np.argpartition(-gains, probes - 1, axis=1)[:, :probes] if probes else np.zeros((n, 0), np.int64)
        moved = np.concatenate([(near.astype(np.uint64) * spread[8 * b:8 * b + 8]).sum(1) for b in range(blocks)])
        out[:, t, 1:] = mixed(plain[:, None] + moved[best] + salt)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _coded(tables: int, blocks: int, probes: int, cell: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                vectors = batch.column("vector")
                lengths = np.diff(vectors.offsets.to_numpy())
                for dim in np.unique(lengths):
                    rows = np.flatnonzero(lengths == dim)
                    part = batch.take(pa.array(rows))
                    x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    unit = unit_rows(x)
                    codes = cells(unit, tables, blocks, probes, cell).view(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "rep": part.column("rep"), "n": part.column("n"), "vector": part.column("vector"),
                        "codes": pa.FixedSizeListArray.from_arrays(pa.array(codes.reshape(-1)), tables * (1 + probes)).cast(
                            pa.list_(pa.int64()))})

    return run


def _linked(threshold: float, tables: int):
    """Links of one tile: rows of block i against rows of block j (against themselves if they are one)."""

    def first_meeting(a: np.ndarray, b: np.ndarray, a_ids, b_ids, cell: int) -> np.ndarray:
        """Whether the pairs (rows of a and b: codes by table) meet in this cell and nowhere before."""
        own_a, own_b = a[:, :, :1], b[:, :, :1]
        a_in_b, b_in_a = (own_a == b).any(2), (own_b == a).any(2)
        table = (a_in_b | b_in_a).argmax(1)
        meets = (a_in_b | b_in_a).any(1)
        rows = np.arange(len(a))
        at_a = a_in_b[rows, table] & (~b_in_a[rows, table] | (a_ids < b_ids) | (own_a == own_b)[rows, table, 0])
        place = np.where(at_a, own_a[rows, table, 0], own_b[rows, table, 0])
        return meets & (place == cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in sorted_groups(batches, ["cell", "i", "j"]):
            ids, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
            block, i, j = (rows.column(c).to_numpy() for c in ("block", "i", "j"))
            cell = rows.column("cell").to_numpy()
            for start, stop in zip(starts[:-1], starts[1:]):
                if stop - start < 2:
                    continue
                own = rows.slice(int(start), int(stop - start))
                same = i[start] == j[start]
                left = np.arange(stop - start) if same else np.flatnonzero(block[start:stop] == i[start])
                right = left if same else np.flatnonzero(block[start:stop] == j[start])
                vectors = own.column("vector").combine_chunks()
                places = vectors.offsets.to_numpy()
                flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
                codes = own.column("codes").combine_chunks().flatten().to_numpy().reshape(len(own), tables, -1)
                sizes = np.diff(places)
                for size in np.unique(sizes):
                    l, r = left[sizes[left] == size], right[sizes[right] == size]
                    if not len(l) or not len(r):
                        continue
                    x = unit_rows(flat[places[l][:, None] + np.arange(size)])
                    y = x if same else unit_rows(flat[places[r][:, None] + np.arange(size)])
                    close = x @ y.T >= threshold
                    if same:
                        close = np.triu(close, 1)
                    a, b = np.nonzero(close)
                    if not len(a):
                        continue
                    a, b = l[a], r[b]
                    for at in range(0, len(a), 4096):
                        p, q = a[at:at + 4096], b[at:at + 4096]
                        met = first_meeting(
                            codes[p], codes[q], ids[start + p], ids[start + q], cell[start])
                        p, q = start + p[met], start + q[met]
                        if not len(p):
                            continue
                        ends = np.append(p, q)
                        to = np.append(q, p)
                        order = np.lexsort((ids[to], ends))
                        ends, to = ends[order], to[order]
                        first = np.append(True, ends[1:] != ends[:-1])
                        count = np.add.reduceat(n[to], np.flatnonzero(first))
                        yield pa.RecordBatch.from_pydict({
                            "rep": pa.array(ids[ends[first]]), "links": pa.array(count.astype(np.int64)),
                            "to": pa.array(ids[ends[first]])})
                        tree_a, tree_b = _forest(ids[p], ids[q])
                        yield pa.RecordBatch.from_pydict({
                            "rep": pa.array(tree_a), "links": pa.array(np.zeros(len(tree_a), np.int64)), "to": pa.array(tree_b)})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (id, least id of its component) that keep the components of the pairs (a, b)."""
    ids, codes = np.unique(np.append(a, b), return_inverse=True)
    p, q = codes[: len(a)], codes[len(a):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, cell: float = CELL,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vec_id of `vectors` (vec_id, embedding)."""
    spark = vectors.sparkSession
    value = F.col("embedding")
    sound = (
        F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
        & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0)
    )
    rows = stored(
        vectors.select("vec_id", F.when(sound, value).alias("vector"))
        .groupBy("vec_id").agg(F.min("vector").alias("vector")), "lattice-rows")
    folded = stored(rows.filter("vector is not null").groupBy("vector").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n")), "lattice-reps")
    coded = stored(folded.mapInArrow(
        _coded(tables, blocks, probes, cell),
        f"rep long, n long, vector {folded.schema['vector'].dataType.simpleString()}, codes array<long>"), "lattice-codes")
    filed = coded.select("rep", F.posexplode("codes").alias("at", "cell")).select(
        "rep", "cell", (F.col("at") % (1 + probes) == 0).alias("own"))
    shared = filed.groupBy("cell").agg(F.count("*").alias("in_cell"), F.max("own").alias("owned")).filter("in_cell > 1 and owned")
    n_blocks = F.ceil(F.col("in_cell") / TILE)
    other = F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))
    tiles = (
        filed.join(shared, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks)).withColumn("other", other)
        .select("rep", "cell", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    keys = ["cell", "i", "j"]
    links = stored(
        tiles.join(coded, "rep").repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(_linked(threshold, tables), "rep long, links long, to long"), "lattice-links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(spark, links.select(F.col("rep").alias("a"), F.col("to").alias("b")), "lattice-components")
    members = rows.filter("vector is not null").join(folded, "vector").select("vec_id", "rep", "n")
    found = (
        members.join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = rows.filter("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
