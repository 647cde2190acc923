"""Balanced sharding of linked documents by label propagation under quotas.

Documents with equal keys are linked. Every row starts with a shard given by a hash of the row. In a round, a join tells the
rows of each (unit, shard) which shard holds most of their neighbours; those elsewhere ask to move there. A shard grants
requests by gain, up to its quota, and what leaves it in the same round is credited. Rows with the same neighbours and the
same shard decide alike, so the state of a round is one row with a count per (unit, shard). Once hardly any request is
granted, the rest of each unit joins its neighbours and shards beyond their quota send whole units away; what cannot be
placed whole fills what is free, so that shard sizes differ by one row at most. `cut_links` counts what lies apart.

A unit is a group of equal texts; only a group of more rows than a shard holds is cut into several units.

Cases: null and empty texts count as equal texts of no bytes; repeated rows are rows of their own; null ids are
ids like others; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.common import fingerprint, ranked, stored, text_of


PIECE_ROWS = 100_000  # rows of a unit that are numbered in one task
BUCKETS = 16  # requests of one gain are granted by buckets


def link_units(rows: DataFrame, largest: int) -> DataFrame:
    """rows with `unit` (links of up to about `largest` rows) and `piece` for keys that occur more than once, else null."""
    often = rows.groupBy("key").agg(F.count("*").alias("n_key")).filter("n_key > 1")
    parted = lambda name, most: F.pmod(F.xxhash64(F.lit(name), "doc_id", "text_crc32"), F.ceil(F.col("n_key") / F.lit(most)))
    linked = F.col("n_key").isNotNull()
    return (
        rows.join(often, "key", "left").withColumn("unit", F.when(linked, F.xxhash64("key", parted("part", largest))))
        .withColumn("piece", F.when(linked, parted("piece", PIECE_ROWS))).drop("n_key")
    )


def grants(flows: list[tuple[int, int, int, int, int]], load: list[int], rooms: list[int]) -> dict[int, tuple[int, int, int]]:
    """Least granted (gain, bucket, source) of each target that takes anything, from flows (gain, bucket, source, target, n).

    All requests are granted at first; a shard that would end above its room (or above what it has, if that is more) takes its
    least ones back, until none does.
    """
    after = list(load)
    asked: dict[int, list] = {}
    for gain, bucket, source, target, n in sorted(flows, reverse=True):
        asked.setdefault(target, []).append((gain, bucket, source, n))
        after[target], after[source] = after[target] + n, after[source] - n
    refused = True
    while refused:
        refused = False
        for target, rows in asked.items():
            while rows and after[target] > max(rooms[target], load[target]):
                *_, source, n = rows.pop()
                after[target], after[source] = after[target] - n, after[source] + n
                refused = True
    return {target: rows[-1][:3] for target, rows in asked.items() if rows}


def propagate(cells: DataFrame, rooms: list[int]) -> DataFrame:
    """cells (unit, shard, n), one row per unit and shard, after rounds of moves towards the shard of most neighbours.

    Each grant joins two cells of a unit, so the rounds end; they stop when less than a hundredth of the requests is
    granted. At most shards x shards x gains x buckets sizes reach the driver.
    """
    turn = 0
    while True:
        best = cells.groupBy("unit").agg(
            F.max(F.struct("n", F.xxhash64(F.lit(f"tie{turn}"), "unit", "shard").alias("tie"), "shard")).alias("best"), F.count("*").alias("parts"))
        asking = cells.join(best.filter("parts > 1"), "unit", "left").select(
            "unit", "shard", "n", F.coalesce("best.shard", "shard").alias("target"),
            F.floor(F.log2(F.coalesce("best.n", "n"))).cast("int").alias("gain"),
            F.pmod(F.xxhash64(F.lit(f"turn{turn}"), "unit"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        asking = stored(asking, "shard-asking")
        load, flows = [0] * len(rooms), []
        for r in asking.groupBy("gain", "bucket", "shard", "target").agg(F.sum("n").alias("n")).collect():
            load[r["shard"]] += r["n"]
            if r["shard"] != r["target"]:
                flows.append(tuple(r))
        least = grants(flows, load, rooms)
        granted = sum(f[4] for f in flows if f[3] in least and f[:3] >= least[f[3]])
        if granted * 100 <= sum(f[4] for f in flows):
            return cells
        listed = cells.sparkSession.createDataFrame([(k, v) for k, v in least.items()], "to int, least struct<gain:int,bucket:int,shard:int>")
        goes = F.col("least").isNotNull() & (F.struct("gain", "bucket", "shard") >= F.col("least"))
        moved = asking.join(F.broadcast(listed), F.col("target") == F.col("to"), "left")  # a row per shard at most
        cells = stored(
            moved.select("unit", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard"), "n")
            .groupBy("unit", "shard").agg(F.sum("n").alias("n")), "shard-cells")
        turn += 1


def gathered(cells: DataFrame) -> DataFrame:
    """One row per unit, in the shard of most of its rows."""
    return cells.groupBy("unit").agg(F.max(F.struct("n", F.xxhash64("unit", "shard").alias("tie"), "shard")).alias("best"), F.sum("n").alias("n")).select(
        "unit", F.col("best.shard").alias("shard"), "n")


def settle(cells: DataFrame, rooms: list[int]) -> DataFrame:
    """cells (unit, shard, n), one row per unit, moved whole out of shards beyond their room until no move is granted.

    A round deals each shard's units to buckets, anew each time; whole buckets leave for shards that have room for them. Each
    move lowers the rows beyond the rooms, so the rounds end. At most shards x buckets sizes reach the driver.
    """
    turn, n_buckets = 0, 1024
    while True:
        dealt = cells.withColumn("bucket", F.pmod(F.xxhash64(F.lit(f"turn{turn}"), "unit"), F.lit(n_buckets)).cast("int"))
        sizes = sorted((r["n"], r["shard"], r["bucket"]) for r in dealt.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).collect())
        load = [0] * len(rooms)
        for n, shard, _ in sizes:
            load[shard] += n
        moves = {}
        # large buckets while they are no larger than what is too much, then the smallest that end it
        for whole, buckets in ((False, sizes[::-1]), (True, sizes)):
            for n, shard, bucket in buckets:
                over = load[shard] - rooms[shard]
                if over <= 0 or (shard, bucket) in moves or not (whole or n <= over):
                    continue
                target = max(range(len(rooms)), key=lambda s: rooms[s] - load[s])
                if load[target] + n <= rooms[target]:
                    moves[shard, bucket] = target
                    load[shard], load[target] = load[shard] - n, load[target] + n
        if not moves:
            return cells
        listed = cells.sparkSession.createDataFrame([(*k, v) for k, v in moves.items()], "shard int, bucket int, target int")
        cells = stored(
            dealt.join(F.broadcast(listed), ["shard", "bucket"], "left")  # at most shards x buckets rows
            .select("unit", F.coalesce("target", "shard").alias("shard"), "n"), "shard-cells")
        turn += 1


def balanced_shards(
    docs: DataFrame, n_shards: int = 24, rows_per_bucket: int = 20_000,
) -> DataFrame:
    """doc_id, size, text_crc32, key, law, shard, slot, grown_shard for every row; law `rows`."""
    base = stored(docs.select(
        "doc_id", (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"), fingerprint(text_of()).alias("key")), "shard-rows")
    n = base.count()
    least = n // n_shards
    n_buckets = max(16, -(-n // rows_per_bucket))
    rooms = [least + (s < n % n_shards) for s in range(n_shards)]
    rows = stored(link_units(base, max(1, max(rooms))), "shard-units")
    linked = rows.filter("unit is not null")
    first = F.pmod(F.xxhash64(F.lit("start"), "doc_id", "unit"), F.lit(n_shards)).cast("int")
    cells = stored(linked.groupBy("unit", first.alias("shard")).agg(F.count("*").alias("n")), "shard-cells")
    cells = settle(stored(gathered(propagate(cells, rooms)), "shard-cells"), rooms)
    placed = stored(linked.join(cells.select("unit", "shard"), "unit"), "shard-placed")
    by_unit = F.xxhash64("unit", "piece")
    held = stored(ranked(placed, ["shard"], by_unit, n_buckets, ["unit", "doc_id", "key"], "slot"), "shard-held")

    # a shard keeps what fits; all else fills the gaps in order
    room = F.lit(least) + (F.col("shard") < n % n_shards).cast("long")
    kept = held.filter(F.col("slot") < room)
    pool = stored(rows.filter("unit is null").unionByName(
        held.filter(F.col("slot") >= room).select(*rows.columns)), "shard-pool")
    spark = docs.sparkSession
    taken = kept.groupBy("shard").agg(F.count("*").alias("taken"))
    running = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    gaps = (
        spark.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(taken, "shard", "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("gap", room - F.col("taken"))
        .withColumn("stop", F.sum("gap").over(running)).withColumn("start", F.col("stop") - F.col("gap"))
        .filter("gap > 0").select("shard", "taken", "start", "stop")
    )
    gaps = F.broadcast(gaps.agg(F.sort_array(F.collect_list(F.struct("stop", "start", "taken", "shard"))).alias("gaps")))  # n_shards entries
    by_link = F.when(F.col("unit").isNotNull(), by_unit).otherwise(F.xxhash64("doc_id", "key"))  # what is left of a unit stays in a row
    queue = ranked(pool, [], by_link, n_buckets, ["unit", "doc_id", "key"], "turn").withColumn("one", F.lit(1))
    gap = F.filter("gaps", lambda g: (F.col("turn") >= g["start"]) & (F.col("turn") < g["stop"]))[0]
    filled = (
        queue.join(gaps.withColumn("one", F.lit(1)), "one").withColumn("gap", gap)
        .withColumn("shard", F.col("gap.shard")).withColumn("slot", F.col("gap.taken") + F.col("turn") - F.col("gap.start"))
    )
    columns = ["doc_id", "size", "text_crc32", "key", "shard", "slot"]
    return kept.select(*columns).unionByName(filled.select(*columns)).select(
        "doc_id", "size", "text_crc32", "key", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: links (pairs of rows with equal keys) and cut (those whose ends lie in different shards)."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    whole = placed.groupBy("key", "shard").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("n"), F.sum(pairs("n")).alias("together"))
    return whole.agg(
        F.coalesce(F.sum(pairs("n")), F.lit(0)).cast("long").alias("links"),
        F.coalesce(F.sum(pairs("n") - F.col("together")), F.lit(0)).cast("long").alias("cut"))


def with_shards(docs: DataFrame, **options) -> DataFrame:
    """docs with law, shard, slot and grown_shard, which replace columns of these names.

    Rows of one id and text are numbered on both sides, so each gets its own place.
    """
    new = ["law", "shard", "slot", "grown_shard"]
    placed = balanced_shards(docs, **options)
    each = Window.partitionBy("_doc", "_text_key").orderBy(F.lit(1))
    left = docs.select(
        F.struct(*[c for c in docs.columns if c not in new]).alias("_row"), F.col("doc_id").alias("_doc"), fingerprint(text_of()).alias("_text_key"))
    right = placed.select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), *new,
        F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("shard", "slot")).alias("_n"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")) & (F.col("_copy") == F.col("_n"))
    return left.withColumn("_copy", F.row_number().over(each)).join(right, same).select("_row.*", *new)
