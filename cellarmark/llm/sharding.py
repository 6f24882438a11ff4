"""Balanced label propagation: linked documents move to their neighbours' shard under exact row quotas.

Every row starts in the shard its id hashes to. Documents with equal texts are neighbours. A group is cut into
cells of at most an eighth of a shard; in each round the cells not yet settled vote for the shards that hold
most of their group (in the first round by where its rows stand, then by where its cells have settled), as many shards
as the group's cells fill, and the votes are admitted, large cells first, as far as each shard's quota reaches. Rounds
go on until no cell is admitted. Cells that fit nowhere, group by group, and then unlinked rows fill the shards up to
their quotas, so the row counts differ by one at most.

Only DataFrame functions run here. What reaches the driver is one count per shard and round.

Defined cases: null text counts as empty; repeated rows are rows of their own; null ids are allowed; an empty table
gives no rows; with fewer rows than shards the last shards stay empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarmark.llm.common import stored, table, text_or_empty
from cellarmark.operators.sliced import row_numbers

N_SHARDS = 40
CELLS_PER_SHARD = 8
ROWS_PER_SLICE = 200_000


def quotas(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def per_shard(values: list[int], shard: Column) -> Column:
    """The value of a shard, from a literal of one number per shard."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), shard.cast("int") + 1)


def filled_by_rank(needs: list[int], rank: Column) -> Column:
    """The shard of the row with this rank (from 0) when shards take ``needs`` rows one after the other."""
    ends = [sum(needs[: s + 1]) for s in range(len(needs))]
    return F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= rank))


def slice_of(key: Column, n_rows: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(64, n_rows // ROWS_PER_SLICE)))


def numbered(rows: DataFrame, group: list[str], n_rows: int, name: str, first: Column | None = None) -> DataFrame:
    """Gapless numbers from 1 within ``group``, by ``first`` if given, in slices that keep a large group spread over many tasks."""
    piece = slice_of(F.col("node"), n_rows)
    piece = piece if first is None else F.struct(first.alias("first"), piece.alias("piece"))
    return row_numbers(rows.withColumn("_piece", piece), group, [F.col("_piece"), F.col("node")], F.col("_piece"), name).drop("_piece")


def admitted(cells: DataFrame, free: list[int], n_rows: int) -> DataFrame:
    """Mark the cells that fit their shard's free rows, large ones first (running sums in slices)."""
    size_class = F.floor(-F.log2(F.col("rows"))).cast("long")
    sliced = cells.withColumn("_slice", F.struct(size_class.alias("c"), slice_of(F.struct("lead", "cell"), n_rows).alias("h")))
    inside = F.sum("rows").over(Window.partitionBy("shard", "_slice").orderBy("lead", "cell").rowsBetween(Window.unboundedPreceding, 0))
    sums = sliced.groupBy("shard", "_slice").agg(F.sum("rows").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("shard", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    reached = sliced.withColumn("_inside", inside).join(sums, ["shard", "_slice"])
    fits = (F.col("shard") >= 0) & (F.col("_inside") + F.col("_before") <= per_shard(free, F.greatest("shard", F.lit(0))))
    return reached.select("lead", "cell", "rows", "shard", fits.alias("fits"))


def dealt(cells: DataFrame, votes: DataFrame, free: list[int]) -> DataFrame:
    """Deal the cells of each group, by number, over as many shards with room as they fill.

    Shards come in the order of the group's votes, then those with most room, by a hash. Cells of a group that fit
    nowhere in this round get shard -1. A group has about ``len(free) * CELLS_PER_SHARD`` cells at most, of two sizes.
    """
    most = max(free)
    asked = votes.groupBy("lead").agg(F.map_from_entries(F.collect_list(F.struct("shard", F.col("votes").cast("long")))).alias("_votes"))
    turn = F.row_number().over(Window.partitionBy("lead", "rows").orderBy("cell")) - 1
    units = cells.withColumn("_turn", turn.cast("long")).join(asked, "lead", "left")
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(int(f)).cast("long").alias("free"), F.lit(int(2 * f < most)).alias("scant")) for s, f in enumerate(free)])

    def wish(s: Column) -> Column:
        got = F.coalesce(F.element_at("_votes", s["shard"]), F.lit(0).cast("long"))
        return F.struct((-got).alias("votes"), s["scant"].alias("scant"), F.xxhash64("lead", s["shard"]).alias("hash"), s["shard"].alias("shard"), F.floor(s["free"] / F.col("rows")).cast("long").alias("holds"))

    wishes = F.array_sort(F.transform(F.filter(shards, lambda s: s["free"] >= F.col("rows")), wish))
    start = F.struct(F.lit(0).cast("long").alias("passed"), F.lit(-1).alias("shard"))

    def step(so_far: Column, w: Column) -> Column:
        here = (so_far["shard"] < 0) & (F.col("_turn") < so_far["passed"] + w["holds"])
        return F.struct((so_far["passed"] + w["holds"]).alias("passed"), F.when(here, w["shard"]).otherwise(so_far["shard"]).alias("shard"))

    return units.select("lead", "cell", "rows", F.aggregate(wishes, start, step)["shard"].alias("shard"))


def assign(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text)."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.sha2(text, 256).alias("digest"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    start = F.pmod(F.xxhash64("node"), F.lit(n_shards)).cast("int")
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "shard-rows").withColumn("shard", start)
    n_rows = rows.count()
    quota = quotas(n_rows, n_shards)
    # Stored, so that the join below reads two plain exchanges and a hot text can be split.
    groups = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1"), "shard-groups")
    linked = rows.join(groups.select("digest", "lead"), "digest").select("node", "lead", "shard")
    cell_rows = max(1, n_rows // n_shards // CELLS_PER_SHARD)
    members = numbered(linked, ["lead"], n_rows, "number").withColumn("cell", F.floor((F.col("number") - 1) / cell_rows))
    members = stored(members.select("node", "lead", "cell", "shard"), "shard-members")

    votes = members.groupBy("lead", "shard").agg(F.count("*").alias("votes"))
    waiting = members.groupBy("lead", "cell").agg(F.count("*").alias("rows"))
    settled, free = None, list(quota)
    while max(free, default=0) > 0:  # a round admits a cell at least, as long as one fits anywhere
        tried = stored(admitted(dealt(waiting, votes, free), free, n_rows), "shard-round")
        taken = tried.filter("fits").groupBy("shard").agg(F.sum("rows").alias("rows"), F.count("*").alias("cells")).collect()  # one row per shard
        for r in taken:
            free[r["shard"]] -= r["rows"]
        done = tried.filter("fits").select("lead", "cell", "rows", "shard")
        settled = done if settled is None else settled.unionByName(done)
        waiting = tried.filter("not fits").select("lead", "cell", "rows")
        if not taken or waiting.isEmpty():
            break
        votes = settled.groupBy("lead", "shard").agg(F.sum("rows").alias("votes"))

    if settled is None:
        settled = waiting.select("lead", "cell", "rows", F.lit(0).alias("shard")).filter("false")
    placed = members.drop("shard").join(settled.select("lead", "cell", "shard"), ["lead", "cell"], "left")
    placed = stored(placed.select("node", "lead", "cell", F.col("shard").cast("int")), "shard-placed")
    # Cells that fit nowhere are fewer than the shards: all free rows together are less than the smallest of them times the shards.
    others = rows.select("node").join(placed, "node", "left").filter("shard is null")
    together = F.struct(F.col("lead").isNull().alias("single"), "lead", "cell")
    others = numbered(others, [], n_rows, "number", together)
    filled = others.select("node", filled_by_rank(free, F.col("number") - 1).cast("int").alias("shard"))
    placed = placed.filter("shard is not null").select("node", "shard")
    slots = numbered(placed.unionByName(filled), ["shard"], n_rows, "number")
    return rows.drop("shard", "digest").join(slots, "node").select("doc_id", "size", "text_crc32", "shard", (F.col("number") - 1).alias("slot"))


def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
