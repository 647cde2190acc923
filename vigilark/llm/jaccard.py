"""N-gram Jaccard join.

A document is its set of distinct word shingles (five words; all words of a shorter text), hashed to 64 bits. Two
documents link when 100 times their intersection is at least 75 times their union.

* Linked sets share a shingle among the first n - ceil(0.75 n) + 1 of each, in any order common to all; shingles that
  are frequent in a bounded sample come last, so that few sets share a key. The sample shapes the work, not the result.
* Keys held by different sets are kept, one for all keys with the same holders.
* Star: the holders of a key are compared with the least of them. Components follow from the verified links.
* Tiles: holders of a key that lie in different components so far are compared with each other, in size bands and
  blocks of bounded size. A set's bitmap has one bit per hash class, on for an odd number of shingles; bits that differ
  bound the overlap from above (a band is one bitmap width; a width can be folded to the next smaller one).
  A tile hands on the rows that may have a partner, never its pairs. Bitmaps SPREAD times as wide are brought to it
  and thin them out, then the sets of the rest: the closest pairs are verified first, pairs that are joined already not
  at all, and a spanning forest of the links comes out.
* What passes is verified by intersecting the sorted hash arrays.

Equal sets are folded before any of this, so copies cost one row each; pairs inside a component are not expanded.

Cases: null, empty and blank texts have no shingles and link with nothing; rows of one id share its links and its
component, each with its own n_shingles; a null id is alone; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.common import components, mixed, pieces, sorted_groups, stored, string_hashes, unit_hash, words_of
from vigilark.llm.decontaminate import if_small

WIDTH = 5
SAMPLE_ROWS, FREQUENT_SHARE, FREQUENT_MOST = 5_000, 0.001, 65_536
TILE = 512
PIECE = 2 << 20  # bytes of text that a task takes apart at once
SPREAD = 8
TILE_BYTES = 256 << 10  # bitmaps of a block; its sets are at most 64 times as large


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    ids, names, offsets = words_of(texts)
    hashed = string_hashes(names)[ids] if len(names) else np.zeros(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    code = hashed.copy()
    for k in range(1, WIDTH):
        whole = max(0, len(code) - k)
        code[:whole] = code[:whole] * step + hashed[k:]
    code = mixed(code)
    for start, stop in zip(offsets[:-1], offsets[1:]):
        n = stop - start
        if n >= WIDTH:
            yield np.unique(code[start:stop - WIDTH + 1])
        elif n:
            total = np.uint64(n)
            for h in hashed[start:stop]:
                total = np.uint64((int(total) * int(step) + int(h)) & ((1 << 64) - 1))
            yield mixed(np.array([total]))
        else:
            yield np.zeros(0, np.uint64)


def bitmap(hashes: np.ndarray, spread: int = 1) -> bytes:
    """Parity of the number of hashes in each class; about `spread` times as many classes as hashes."""
    width = spread << max(6, int(len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signed(value: np.ndarray) -> np.ndarray:
    return value.view(np.int64)


def _signatures(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most_bytes=PIECE):
                n, first, second, bits, keys = [], [], [], [], []
                for own in shingle_sets(part.column("text")):
                    at = np.searchsorted(frequent, own)
                    often = np.zeros(len(own), bool)
                    inside = at < len(frequent)
                    often[inside] = frequent[at[inside]] == own[inside]
                    prefix = len(own) - -(-3 * len(own) // 4) + 1 if len(own) else 0
                    n.append(len(own))
                    first.append(_first_print(own))
                    second.append(int(np.sum(mixed(own ^ np.uint64(0x5555555555555555)), dtype=np.uint64).view(np.int64)))
                    bits.append(bitmap(own) if len(own) else b"")
                    keys.append(_signed(np.append(own[~often], own[often])[:prefix]))
                ends = np.append(0, np.cumsum([len(k) for k in keys]))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "f1": pa.array(first, pa.int64()),
                    "f2": pa.array(second, pa.int64()), "bits": pa.array(bits, pa.binary()),
                    "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))})

    return run


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, most_bytes=PIECE):
            found = list(shingle_sets(part.column("text")))
            if found:
                yield pa.RecordBatch.from_pydict({"h": pa.array(_signed(np.concatenate(found)))})


def _first_print(own: np.ndarray) -> int:
    return int(np.sum(mixed(own + np.uint64(1)), dtype=np.uint64).view(np.int64))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wide bitmaps of rows whose fingerprint is the wanted one."""
    for sets in _sets(batches):
        lists = sets.column("set")
        flat, places = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        yield pa.RecordBatch.from_pydict({
            "id": sets.column("id"), "bits": pa.array([bitmap(flat[a:b], SPREAD) for a, b in zip(places[:-1], places[1:])], pa.binary())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of rows whose fingerprint is the wanted one: of several rows of an id, those that stand for it."""
    for batch in batches:
        for part in pieces(batch, most_bytes=PIECE):
            found = list(shingle_sets(part.column("text")))
            wanted = [i for i, (own, f1) in enumerate(zip(found, part.column("f1").to_pylist())) if _first_print(own) == f1]
            part, found = part.take(pa.array(wanted, pa.int64())), [found[i] for i in wanted]
            ends = np.append(0, np.cumsum([len(k) for k in found]))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({
                "id": part.column("doc_id"), "set": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(flat)))})


def frequent_shingles(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Sorted hashes of shingles held by many of about `sample_rows` documents; at most FREQUENT_MOST."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.filter(unit_hash("frequent", "doc_id") < share).select("text")
    least = max(3, int(FREQUENT_SHARE * sample_rows))
    top = (
        sample.mapInArrow(_all_shingles, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        .orderBy(F.desc("n"), "h").limit(FREQUENT_MOST)
    )
    return np.sort(np.array([r[0] for r in top.select("h").collect()], np.int64).view(np.uint64))


def _tile_pairs(rep, n, label, block, i, j, bits) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row, row, share of bits that differ) of a tile's pairs that lie in different components and may link."""
    if len(rep) < 2 or (label == label[0]).all():
        return None
    at = np.arange(len(rep))
    left, right = at[block == i], at[block == j]
    width = np.array([len(x) for x in bits])
    found = []
    for w in np.unique(width):
        for other in (w, 2 * w):
            turns = [(left[width[left] == w], right[width[right] == other])]
            if i != j and other != w:
                turns.append((right[width[right] == w], left[width[left] == other]))
            for p, q in turns:
                if len(p) and len(q):
                    found += _allowed(p, q, w, other, bits, n, label, w == other and i == j)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else None


_TILE = "key long, i long, j long, block long, rep long, n long, label long"


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a tile that have a partner whose size and bitmap allow a link."""
    for rows, starts in sorted_groups(batches, ["key", "i", "j"]):
        names = ("rep", "n", "label", "block", "i", "j")
        columns = [rows.column(c).to_numpy() for c in names]
        for start, stop in zip(starts[:-1], starts[1:]):
            rep, n, label, block, i, j = (c[start:stop] for c in columns)
            pairs = _tile_pairs(rep, n, label, block, i[0], j[0], rows.column("bits").slice(start, stop - start).to_pylist())
            if pairs:
                yield from rows.select([f.split()[0] for f in _TILE.split(", ")]).take(
                    pa.array(start + np.unique(np.append(pairs[0], pairs[1])))).to_batches()


def _joined_in_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a tile, verified by their sets: the closest first, none between rows that are joined already."""
    for rows, starts in sorted_groups(batches, ["key", "i", "j"]):
        names = ("rep", "n", "label", "block", "i", "j")
        columns = [rows.column(c).to_numpy() for c in names]
        lists = rows.column("set").combine_chunks()
        flat, places = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for start, stop in zip(starts[:-1], starts[1:]):
            rep, n, label, block, i, j = (c[start:stop] for c in columns)
            sets = [flat[places[k]:places[k + 1]] for k in range(start, stop)]
            pairs = _tile_pairs(rep, n, label, block, i[0], j[0], [bitmap(own, SPREAD) for own in sets])
            if not pairs:
                continue
            group = {x: x for x in label.tolist()}

            def root(x: int) -> int:
                while group[x] != x:
                    group[x] = x = group[group[x]]
                return x

            of, out = label.tolist(), []
            for a, b in zip(*(x[np.argsort(pairs[2], kind="stable")].tolist() for x in pairs[:2])):
                x, y = root(of[a]), root(of[b])
                if x != y and _links(sets[a], sets[b]):
                    group[x] = y
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array(rep[[a for a, _ in out]]), "b": pa.array(rep[[b for _, b in out]])})


def _links(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def _allowed(p, q, w, other, bits, n, label, same) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of p, row of q, share of bits that differ) of pairs that may link."""
    y = np.frombuffer(b"".join(bits[k] for k in q), np.uint8).reshape(len(q), -1)
    if other != w:
        y = y[:, :w] ^ y[:, w:]
    y = np.ascontiguousarray(y).view(np.uint64)
    x = np.frombuffer(b"".join(bits[k] for k in p), np.uint64).reshape(len(p), -1)
    step = max(1, (1 << 20) // max(1, y.size))
    for at in range(0, len(p), step):
        own = p[at:at + step]
        differ = np.bitwise_count(x[at:at + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
        small, large = np.minimum(n[own][:, None], n[q]), np.maximum(n[own][:, None], n[q])
        good = (7 * differ <= small + large) & (4 * small >= 3 * large) & (label[own][:, None] != label[q])
        if same:
            good &= own[:, None] < q
        a, b = np.nonzero(good)
        if len(a):
            yield own[a], q[b], differ[a, b] / (small + large)[a, b]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = batch.column("set_a"), batch.column("set_b")
        x, y = one.values.to_numpy(), two.values.to_numpy()
        at, to = one.offsets.to_numpy(), two.offsets.to_numpy()
        keep = []
        for k in range(batch.num_rows):
            a, b = x[at[k]:at[k + 1]].view(np.uint64), y[to[k]:to[k + 1]].view(np.uint64)
            keep.append(_links(a, b))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        if kept.num_rows:
            yield kept.select(["a", "b"])


def _bitmaps_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, na, bits_a, b, nb, bits_b) whose bitmaps leave room for a link."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*[batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b")]):
            one, two = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
            while len(two) > len(one):
                two = two[: len(two) // 2] ^ two[len(two) // 2:]
            keep.append(7 * int(np.bitwise_count(one ^ two).sum()) <= n + m)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def sets_of(docs: DataFrame, best: DataFrame, ids: DataFrame, wide: bool = False) -> DataFrame:
    """id, set (sorted hashes) of the documents with these ids, or id, bits (wide bitmaps); a stored table.

    `best` has the fingerprint of each id.
    """
    ids = stored(ids.distinct().join(best.select("doc_id", "f1"), "doc_id"), "jaccard-ids")
    texts = docs.select("doc_id", "text").join(if_small(ids), "doc_id")
    if wide:
        return stored(texts.mapInArrow(_wide, "id long, bits binary"), "jaccard-wide")
    return stored(texts.mapInArrow(_sets, "id long, set array<long>"), "jaccard-sets")


def verified(docs: DataFrame, best: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids that link; `pairs` is a stored table, `best` has the fingerprint of each id."""
    sets = sets_of(docs, best, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    both = (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")
    )
    return both.mapInArrow(_verified, "a long, b long")


def near_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    frequent = frequent_shingles(docs)
    rows = stored(docs.select("doc_id", "text").mapInArrow(
        _signatures(frequent), "doc_id long, n long, f1 long, f2 long, bits binary, keys array<long>"), "jaccard-rows")
    whole = rows.filter("n > 0 and doc_id is not null")
    # an id with several rows stands for the largest of its sets
    best = whole.groupBy("doc_id").agg(F.max_by(F.struct("n", "f1", "f2", "bits"), F.struct("n", "f1", "f2")).alias("s")).select("doc_id", "s.*")
    best = stored(best, "jaccard-best")
    reps = stored(best.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")), "jaccard-reps")

    # rows on the move are as narrow as can be: keys alone are counted, holders follow for those that occur twice
    held = whole.select(F.explode("keys").alias("key"), "f1")
    twice = stored(held.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "jaccard-twice")
    shared = stored(held.join(twice, "key").groupBy("key", "f1").agg(F.count("*").alias("c")), "jaccard-shared")
    keys = (
        shared.groupBy("key").agg(
            F.count("*").alias("c"), F.min("f1").alias("lo"), F.bit_xor(F.xxhash64("f1")).alias("x"), F.sum(F.shiftright(F.xxhash64("f1"), 24)).alias("s"))
        .filter("c > 1").groupBy("lo", "c", "x", "s").agg(F.min("key").alias("key")).select("key")
    )
    holders = stored(shared.join(keys, "key").join(reps, "f1").select("key", "rep", "n", "bits"), "jaccard-holders")

    # star: each holder against the least holder of its key
    centre = holders.groupBy("key").agg(F.min(F.struct("rep", "n", "bits")).alias("c")).select(
        "key", F.col("c.rep").alias("a"), F.col("c.n").alias("na"), F.col("c.bits").alias("bits_a"))
    star = (
        holders.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")).join(centre, "key")
        .filter("a <> b and 4 * least(na, nb) >= 3 * greatest(na, nb)").drop("key").mapInArrow(_bitmaps_allow, "a long, b long")
    )
    links = stored(verified(docs, best, stored(star.distinct(), "jaccard-star")), "jaccard-links")
    label = components(spark, links, "jaccard-first").select(F.col("id").alias("rep"), F.col("component").alias("label"))

    # tiles: holders of a key in different components; wide bitmaps, then sets, follow those with hope into their tiles
    named = stored(holders.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "jaccard-named")
    mixed_keys = named.groupBy("key").agg(
        F.count("*").alias("in_key"), F.sum(F.length("bits")).alias("bytes"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    n_blocks = F.ceil(F.greatest(F.col("in_key") / TILE, F.col("bytes") / TILE_BYTES))
    tiles = (
        named.join(mixed_keys.select("key", "in_key", "bytes"), "key").withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("key", "i", "j", "block", "rep", "n", "label", "bits")
    )
    by = ["key", "i", "j"]
    hopeful = stored(tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(_hopeful, _TILE), "jaccard-hopeful")
    wide = sets_of(docs, best, hopeful.select(F.col("rep").alias("doc_id")), True).withColumnRenamed("id", "rep")
    hopeful = stored(
        hopeful.join(wide, "rep").repartition(*by).sortWithinPartitions(*by).mapInArrow(_hopeful, _TILE), "jaccard-hopeful")
    sets = sets_of(docs, best, hopeful.select(F.col("rep").alias("doc_id"))).withColumnRenamed("id", "rep")
    more = stored(
        hopeful.join(sets, "rep").repartition(*by).sortWithinPartitions(*by).mapInArrow(_joined_in_tile, "a long, b long"), "jaccard-more")

    joined = components(spark, links.unionByName(more), "jaccard-components").withColumnRenamed("id", "rep")
    found = (
        best.join(reps.drop("bits"), ["n", "f1", "f2"]).join(joined, "rep", "left")
        .select(F.col("doc_id").alias("_id"), F.coalesce("component", "rep").alias("component_id"))
    )
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the smallest id of each component; same columns. Rows without shingles stay, as do null ids.

    Of several rows of a kept id one stays: the first by text, then source.
    """
    gone = if_small(stored(near_documents(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone"))
    kept = docs.join(gone, "doc_id", "left_anti")
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1 and doc_id is not null").select("doc_id"), "jaccard-again")
    if not again.head(1):
        return kept
    twice = if_small(again)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source"))
    single = kept.join(twice, "doc_id", "left_anti")
    return single.select(*docs.columns).unionByName(
        kept.join(twice, "doc_id", "left_semi").withColumn("_number", number).filter("_number = 1").select(*docs.columns))
