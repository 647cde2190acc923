"""Suffix-array removal of repeated passages.

Every byte covered by a string of `LENGTH` bytes that also starts earlier (smaller id, or earlier in the document) is
removed. Strings are judged on the input.

* A string's anchor is the least of the hashes of its `GRAM`-byte pieces (the leftmost of equal ones), so equal
  strings have equal anchors. Neighbouring strings with one anchor form a run. Only runs whose anchor occurs twice go on.
* Equal runs are folded: all but the first are removed whole; the first ones stand for them.
* Different runs with a common anchor are suffix sorted by the difference-cover algorithm: triples at positions 1 and 2
  modulo 3 are sorted and named, names are sorted by recursion until they are unique or cover `LENGTH` bytes, the other
  suffixes are sorted by their first byte and the rank of the next suffix and merged in. Neighbours in the array are
  compared by their first `LENGTH` bytes; of each class of equal strings all but the first start are removed.

Anchors are the buckets of the distributed sort: no two equal strings lie in different buckets. A bucket of many
different runs is cut further, by place of the anchor and content of the string. Runs are compared by 64-bit hashes
when they are folded, and byte by byte in the array.

Cases: null and empty texts have no bytes; texts under `LENGTH` bytes lose none; a null id counts as the largest id;
ids are the documents' order, so rows that share an id are taken as one document's alternatives and a string in one does not
count as earlier for the other at the same place; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import bytes_of, group_starts, mixed, pieces, sorted_groups, stored, text_of
from vigilark.llm.decontaminate import BROADCAST_ROWS, if_small

LENGTH, GRAM = 100, 28
LARGE_BUCKET = 4096  # runs
PLACE_BITS = 30
NULL_ID = (1 << 63) - 1
_FACTOR = 0x9E3779B97F4A7C15


def suffix_array(text: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """Suffixes of a sequence of positive numbers in order, by difference cover modulo 3.

    Suffixes that agree in their first `depth` numbers may come in any order.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a closing triple parts ones from twos
    sample = np.concatenate([ones, twos])
    triples = _keys(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(triples)
    fresh = np.ones(len(sample), np.int64)
    fresh[1:] = triples[order[1:]] != triples[order[:-1]]
    if depth > 3 and fresh.sum() < len(sample):
        names = np.empty(len(sample), np.int64)
        names[order] = np.cumsum(fresh)
        order = suffix_array(names, -(-depth // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    order = sample[order]
    order = order[order < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_packed(s[zeros], rank[zeros + 1]))]
    # where each of the others falls among the sample: against ones by one number, against twos by two
    in_one, in_two = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(_packed(s[in_one], rank[in_one + 1]), _packed(s[zeros], rank[zeros + 1]))
    two = np.concatenate([in_two, zeros])
    key = _keys(s[two], s[two + 1], rank[two + 2])
    before = before + np.searchsorted(key[: len(in_two)], key[len(in_two):])
    place = np.arange(len(zeros)) + before
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = zeros
    out[free] = order
    return out


def _keys(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One number per triple, in the order of the triples; a pair is named by sorting only if three numbers do not fit."""
    widths = [int(x.max(initial=0)).bit_length() for x in (a, b, c)]
    if sum(widths) <= 63:
        return (a << np.int64(widths[1] + widths[2])) | (b << np.int64(widths[2])) | c
    return _packed(_named(a, b), c)


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high << np.int64(32)) | low


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs, from 0, equal for equal pairs."""
    return np.unique(_packed(a, b), return_inverse=True)[1].astype(np.int64)


def anchored_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor's place, anchor hash, content hash) of all runs; places in `data`."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    table = mixed(np.arange(1, 257, dtype=np.uint64))
    factor = np.uint64(_FACTOR | 1)
    inverse = np.uint64(pow(_FACTOR | 1, -1, 1 << 64))
    power = np.ones(n, np.uint64)
    power[1:] = factor
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * power, out=total[1:])
    power[1:] = inverse
    power[0] = 1
    np.cumprod(power, out=power)
    m = n - GRAM + 1
    gram = mixed((total[GRAM:] - total[:m]) * power[:m])
    least = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(m, dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width:])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends)
    anchor = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    lo, count, at = starts[first], np.diff(np.append(first, len(starts))), anchor[first]
    content = (total[lo + count + LENGTH - 1] - total[lo]) * power[lo]
    content = mixed(content + (count.astype(np.uint64) << np.uint64(20)) + (at - lo).astype(np.uint64) * np.uint64(_FACTOR))
    return lo, count, at, gram[at], content


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            data, offsets = bytes_of(part.column("text"))
            lo, count, at, key, content = anchored_runs(data, offsets)
            row = np.searchsorted(offsets, lo, side="right") - 1
            place = ((lo - offsets[row]) << 16) | (count << 8) | (at - lo)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(key.view(np.int64)), "run": pa.array(content.view(np.int64)),
                "id": part.column("id").take(pa.array(row)), "place": pa.array(place)})


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of runs; runs of large buckets as single strings in buckets of their own."""
    for batch in batches:
        bucket, place, ids, count, content = [], [], [], [], []
        for own, text, runs in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            data = text.encode()
            for run in runs:
                start, n, anchor = run["place"] >> 16, (run["place"] >> 8) & 255, run["place"] & 255
                if run["large"]:
                    for k in range(n):
                        string = data[start + k:start + k + LENGTH]
                        bucket.append(int.from_bytes(hashlib.blake2b(string, digest_size=8, key=str(
                            (run["key"], anchor - k)).encode()).digest(), "little", signed=True))
                        ids.append(own), place.append(start + k), count.append(1), content.append(string)
                else:
                    bucket.append(run["key"]), ids.append(own), place.append(start), count.append(n)
                    content.append(data[start:start + n + LENGTH - 1])
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(bucket, pa.int64()), "id": pa.array(ids, pa.int64()), "start": pa.array(place, pa.int64()),
            "n": pa.array(count, pa.int64()), "content": pa.array(content, pa.binary())})


def repeated_starts(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the string at each place of `data` (runs one after another) also starts earlier in another run."""
    lengths = np.diff(offsets)
    # a closing number of its own after each run: no string goes on into the next
    spaced = np.zeros(len(data) + len(lengths), np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(data)) + owner
    spaced[at] = data.astype(np.int64) + 1
    spaced[offsets[1:] + np.arange(len(lengths))] = 257 + np.arange(len(lengths))
    order = suffix_array(spaced, LENGTH)
    run = np.repeat(np.arange(len(lengths)), lengths + 1)
    inside = np.arange(len(spaced)) - (offsets[:-1] + np.arange(len(lengths)))[run]
    whole = inside + LENGTH <= lengths[run]
    order = order[whole[order]]
    if not len(order):
        return np.zeros(len(data), bool)
    same = np.zeros(len(order), bool)
    same[1:] = True
    words = np.ndarray(len(data) - 7, np.uint64, data.tobytes(), strides=(1,)).copy()  # eight bytes from each place
    begin = order - run[order]
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # adjacent prefixes
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = words[begin[live] + k] == words[begin[live - 1] + k]
    several = same | np.append(same[1:], False)
    group, order = np.cumsum(~same)[several], order[several]
    if not len(order):
        return np.zeros(len(data), bool)
    by = np.lexsort((starts[run[order]] + inside[order], ids[run[order]], group))
    first = np.ones(len(order), bool)
    first[1:] = group[by][1:] != group[by][:-1]
    repeated = np.zeros(len(spaced), bool)
    repeated[order[by[~first]]] = True
    return repeated[at]


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, groups in sorted_groups(batches, ["bucket"]):
        keep = np.repeat(np.diff(groups) > 1, np.diff(groups))
        rows = rows.filter(pa.array(keep))
        if not rows.num_rows:
            continue
        groups = group_starts(rows, ["bucket"])
        size = np.cumsum(np.diff(groups))
        begin = 0
        while begin < len(size):  # whole buckets, some thousand runs together
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + 8192, side="right")))
            part = rows.slice(int(groups[begin]), int(groups[end] - groups[begin])).combine_chunks()
            begin = end
            data, offsets = bytes_of(part.column("content").chunk(0))
            ids, starts = part.column("id").to_numpy(), part.column("start").to_numpy()
            hit = repeated_starts(data, offsets, ids, starts)
            at = np.flatnonzero(hit)
            run = np.searchsorted(offsets, at, side="right") - 1
            place = starts[run] + at - offsets[run]
            new = np.ones(len(at), bool)
            new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))[: len(first)] - 1
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids[run[first]]), "start": pa.array(place[first]), "stop": pa.array(place[last] + LENGTH)})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for own, text, spans in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")]):
            data = text.encode()
            merged: list[list[int]] = []
            for span in sorted((s["start"], min(s["stop"], len(data))) for s in spans or [] if s["start"] < len(data)):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            digest, at = hashlib.sha256(), 0
            for start, stop in merged:
                digest.update(data[at:start])
                at = stop
            digest.update(data[at:])
            values = (own, len(data), sum(b - a for a, b in merged), len(merged), digest.hexdigest(),
                      [{"start": a, "stop": b} for a, b in merged])
            for k, v in zip(out, values):
                out[k].append(v)
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, start, stop) byte spans to remove, overlapping; `docs` has id and text."""
    schema = "key long, run long, id long, place long"
    often = stored(
        docs.mapInArrow(_runs, schema).groupBy("key").agg(F.count("*").alias("n"), F.min("run").alias("lo"), F.max("run").alias("hi"))
        .filter("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("differ")), "suffix-anchors")
    found = stored(docs.mapInArrow(_runs, schema).join(often, "key"), "suffix-runs")
    firsts = stored(found.groupBy("key", "run", "differ").agg(F.min(F.struct("id", "place")).alias("f"))
                    .select("key", "differ", "f.id", "f.place"), "suffix-firsts")
    again = (
        found.select("id", "place", F.lit(False).alias("first")).unionByName(firsts.select("id", "place", F.lit(True).alias("first")))
        .groupBy("id", "place").agg(F.max("first").alias("first")).filter("not first")
        .select("id", F.shiftright("place", 16).alias("start"),
                (F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(255) + (LENGTH - 1)).alias("stop"))
    )
    open_runs = firsts.filter("differ")
    large = open_runs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE_BUCKET).select("key", F.lit(True).alias("large"))
    per_doc = stored(
        open_runs.join(large, "key", "left").groupBy("id")
        .agg(F.collect_list(F.struct("key", "place", F.coalesce("large", F.lit(False)).alias("large"))).alias("runs")), "suffix-open")
    texts = docs.select("id", "text").join(if_small(per_doc.select("id")), "id", "left_semi")
    contents = texts.join(per_doc, "id").mapInArrow(_contents, "bucket long, id long, start long, n long, content binary")
    array = contents.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _sorted_buckets, "id long, start long, stop long")
    return again.unionByName(array)


def without_repeats(docs: DataFrame) -> DataFrame:
    """RESULT columns for every row of docs (doc_id, text): what is removed, and a digest of what is kept."""
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"))
    spans = stored(repeated_spans(rows.select("id", "text")).groupBy("id").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-spans")
    if spans.count() > BROADCAST_ROWS:
        return rows.join(spans, "id", "left").select("doc_id", "text", "spans").mapInArrow(_cut, RESULT)
    ids = F.broadcast(spans.select("id"))
    whole = rows.join(ids, "id", "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
        F.array().cast("array<struct<start:long,stop:long>>").alias("spans"))
    cut = rows.join(ids, "id", "left_semi").join(spans, "id").select("doc_id", "text", "spans").mapInArrow(_cut, RESULT)
    return whole.unionByName(cut)
