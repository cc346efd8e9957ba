"""Mixing sources to target weights by dependent rounding of copy numbers.

Every source gets a target in words, and all its documents the same fractional number of copies. The
fractions are rounded in pairs: words move at random from one document to the other until one of the two
has a whole number of copies, which keeps the source's words and every document's expectation. Blocks of
documents are rounded one after another inside, and leave at most one fraction each; these form the blocks
of the next level, so one source of any size is rounded by a tree of small tasks. Everything here is a
DataFrame expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdrift.llm.frames import col, stored

# White space between words, and the weights of sources in order, repeating.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class Setting:
    """``block_rows`` fractions are rounded by one expression; ``most`` is the largest number of copies."""

    weights: Sequence[int] = WEIGHTS
    most: int = 3
    block_rows: int = 64
    seed: int = 13


def cut(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in ranges of ``order`` with the range's number and a place that grows with the order, stored."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(
        ranged.select("*", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("place"))
    )


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Add what ``sums`` come to over all rows before, in two levels: inside ranges, and over whole ranges."""
    ranges = cut(df, order)
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: their number is that of shuffle partitions.
    whole = ranges.groupBy("slice").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = whole.select("slice", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_offset") for n in sums])
    inside = Window.partitionBy("slice").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return (
        local.join(offsets, "slice")
        .withColumns({n: F.col(n) + F.col(f"{n}_offset") for n in sums})
        .drop("slice", "place", *[f"{n}_offset" for n in sums])
    )


def targets(sizes: DataFrame, setting: Setting) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above ``most`` times its source.

    What sources at their limit leave is shared among the others by weight. In order of limit by weight the
    level that all others share rises up to the first source below its limit and falls after it, so it is
    the largest of the levels.
    """
    repeating = F.array(*[F.lit(int(w)) for w in setting.weights])
    number = {"number": F.lit(1)}
    ordered = running(sizes, [F.col("source").asc_nulls_last()], number)
    weighted = stored(
        ordered.withColumn("weight", F.get(repeating, F.pmod(F.col("number"), F.size(repeating)).cast("int")))
        .withColumn("limit", F.col("source_size") * setting.most)
        .drop("number")
    )
    ratio = (F.col("limit") / F.col("weight")).alias("ratio")
    filled = running(
        weighted.select("source", "limit", "weight", ratio),
        [F.col("ratio"), F.col("source").asc_nulls_last()],
        {"limits_before": F.col("limit"), "weights_before": F.col("weight")},
    )
    total = weighted.agg(F.struct(F.sum("source_size").alias("words"), F.sum("weight").alias("weight"))).scalar()
    left = total["words"] - F.col("limits_before")
    level = filled.agg(F.max(left / (total["weight"] - F.col("weights_before")))).scalar()
    target = F.least(F.col("limit").cast("double"), F.col("weight") * level)
    return weighted.select("source", "source_size", "n", target.alias("target"))


def moved(carried: Column, row: Column) -> Column:
    """One step: the fraction carried along and the next one, moved until one of them is whole.

    A struct of ``done`` (those that became whole, as (id, size, up)) and ``carried``.
    """
    p, q, s, t = carried["p"], row["p"], carried["size"], row["size"]
    # Words that can move from the next document to the carried one, and the other way.
    up_room, up_gift = (1 - p) * s, q * t
    down_gift, down_room = p * s, (1 - q) * t
    more, less = F.least(up_room, up_gift), F.least(down_gift, down_room)
    rises = row["u"] * (more + less) < less

    def settled(first: Column, up: int) -> Column:
        return F.struct(first["id"].alias("id"), first["size"].alias("size"), F.lit(up).alias("up"))

    def going(kept: Column, share: Column) -> Column:
        return F.struct(kept["id"].alias("id"), kept["size"].alias("size"), share.alias("p"))

    # The carried one reaches 1 or the next one 0; else the carried one reaches 0 or the next one 1.
    return (
        F.when(rises & (up_room <= up_gift), F.struct(settled(carried, 1).alias("done"), going(row, q - more / t).alias("left")))
        .when(rises, F.struct(settled(row, 0).alias("done"), going(carried, p + more / s).alias("left")))
        .when(down_gift <= down_room, F.struct(settled(carried, 0).alias("done"), going(row, q + less / t).alias("left")))
        .otherwise(F.struct(settled(row, 1).alias("done"), going(carried, p - less / s).alias("left")))
    )


def rounded(rows: Column, id_type: str) -> Column:
    """The rows of a block, an array of (id, size, p, u), rounded one after another.

    Shares that come out as 0 or 1, or beyond by the last bit, settle at the next step.
    """
    settled, going = f"struct<id: {id_type}, size: bigint, up: int>", f"struct<id: {id_type}, size: bigint, p: double>"
    state = f"struct<done: array<{settled}>, left: {going}>"
    start = F.struct(F.array().cast(f"array<{settled}>").alias("done"), F.lit(None).cast(going).alias("left")).cast(state)

    def step(at: Column, row: Column) -> Column:
        moving = moved(at["left"], row)
        alone = F.struct(row["id"].alias("id"), row["size"].alias("size"), row["p"].alias("p"))
        return (
            F.when(at["left"].isNull(), F.struct(at["done"].alias("done"), alone.alias("left")))
            .otherwise(F.struct(F.array_append(at["done"], moving["done"]).alias("done"), moving["left"].alias("left")))
            .cast(state)
        )

    return F.aggregate(rows, start, step)


def uniform(seed: int, level: int, *by: str) -> Column:
    """A number in [0, 1) from a hash: the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *by), 11) / F.lit(float(1 << 53))


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", setting: Setting = Setting()
) -> DataFrame:
    """One row per row of ``docs``: the key, source, size, source_size, target, copies and taken.

    ``size`` counts words; ``taken`` is copies times size. The words taken of a source differ from its target
    by less than one document's size, the one whose fraction is left at the root of its tree. A document's
    copies are the whole part of target by source size or one more, never above ``most``. Random numbers are
    hashes of the seed, the source and the row's place among the source's rows ordered by a hash of the key,
    the key and the size, so reruns agree whatever the partitioning is.

    Null and empty texts have size 0, no copies and take nothing. Long texts are counted whole. A null source
    is a source of its own, the last one; sources are ordered by code point. Null and repeated keys are
    allowed: repeated rows are rounded each. If there are no words at all, targets are 0. An empty table
    gives an empty one. Only the named columns are returned.
    """
    key_type = docs.schema[key].dataType.simpleString()
    size = F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")
    named = docs.select(col(key).alias("id"), col(source).alias("source"), size.alias("size"))
    # Rows of a source in an order that only their content decides; repeated rows are spread by a last column.
    mixed = named.withColumn("h", F.xxhash64(F.lit(setting.seed), "id", "size")).withColumn("tie", F.monotonically_increasing_id())
    rows = cut(mixed, [F.col("source").asc_nulls_last(), F.col("h"), F.col("id").asc_nulls_last(), F.col("size"), F.col("tie")])
    cells = stored(
        rows.groupBy("slice", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("place").alias("first"))
    )
    sizes = cells.groupBy("source").agg(F.sum("n").alias("n"), F.sum("words").alias("source_size"))
    wanted = stored(targets(sizes, setting))
    # A source has one cell per range at most, and a cell's rows lie side by side.
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cells.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).select("slice", "source", "shift")
    per_cell = shifts.withColumnRenamed("source", "s").join(wanted, F.col("s").eqNullSafe(F.col("source"))).drop("s", "n")
    per_cell = per_cell.withColumnsRenamed({"slice": "cell_slice", "source": "cell_source"})
    of_cell = (F.col("slice") == F.col("cell_slice")) & F.col("source").eqNullSafe(F.col("cell_source"))
    copies = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    base = F.when(F.col("size") > 0, F.floor(copies)).otherwise(0).cast("int")
    placed = stored(
        rows.join(per_cell, of_cell)
        .withColumn("rank", F.col("place") + F.col("shift"))
        .withColumn("base", base)
        .withColumn("p", F.when(F.col("size") > 0, copies - F.floor(copies)).otherwise(0.0))
        .select("id", "source", "size", "source_size", "target", "rank", "base", "p")
    )
    # The tree carries a row's rank as its id, whole numbers in each source.
    fractions = placed.where("p > 0").select("source", "rank", F.col("rank").alias("id"), "size", "p")
    done, level = [], 0
    longest = wanted.agg(F.max("n")).first()[0] or 0
    while longest > 0:
        entry = F.struct("rank", "id", "size", "p", uniform(setting.seed, level, "source", "rank").alias("u"))
        block = F.floor(F.col("rank") / setting.block_rows)
        state = rounded(F.array_sort(F.collect_list(entry)), "bigint").alias("state")
        tree = stored(fractions.groupBy("source", block.alias("block")).agg(state).select("source", "block", "state.*"))
        done.append(tree.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.up"))
        left = tree.where("left IS NOT NULL").select("source", F.col("block").alias("rank"), "left.id", "left.size", "left.p")
        longest, level, fractions = (longest - 1) // setting.block_rows, level + 1, left
    if done:
        by_chance = (uniform(setting.seed, level, "source", "id") < F.col("p")).cast("int")
        done.append(fractions.select("source", "id", by_chance.alias("up")))
    return with_copies(placed, done, key, key_type, source)


def with_copies(placed: DataFrame, done: list[DataFrame], key: str, key_type: str, source: str) -> DataFrame:
    """Rows with their copies: the whole part, and one more where the tree rounded up."""
    raised = None
    for part in done:
        ups = part.where("up = 1").select(F.col("source").alias("up_source"), F.col("id").alias("up_rank"))
        raised = ups if raised is None else raised.unionByName(ups)
    if raised is None:
        counted = placed.withColumn("copies", F.col("base"))
    else:
        same = (placed["rank"] == raised["up_rank"]) & placed["source"].eqNullSafe(raised["up_source"])
        counted = placed.join(raised, same, "left").withColumn("copies", F.col("base") + F.col("up_rank").isNotNull().cast("int"))
    return counted.select(
        F.col("id").alias(key), F.col("source").alias(source), "size", F.col("source_size"), "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
