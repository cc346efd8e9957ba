"""Near-duplicate embeddings: a forest of random-projection trees with spill, compared within leaves.

Equal vectors are one class from the start. Each tree splits the space again and again at the median of a
random projection; vectors close to a split go both ways. Leaves are compared in blocks, in double
precision, and every pair counts in the first leaf only that it shares over all trees. A task returns a
count of links per vector and a spanning forest, never the links themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdrift.llm.components import components
from sparkdrift.llm.frames import blocked, col, map_groups, stored, to_batch
from sparkdrift.llm.minhash import smallest_labels
from sparkdrift.llm.unigram import places
from sparkdrift.llm.vectors import matrix, usable_vectors, widest


@dataclass(frozen=True)
class Setting:
    """The forest. Splits are fitted on at most ``sample`` vectors, taken by a hash; all vectors are placed.

    ``spill`` is the share of a projection's spread, on each side of a split, that goes both ways. At a
    cosine of 0.9 in 64 dimensions a split parts a pair with a probability of about 0.024, so six trees of
    ten levels miss one with a probability of about 1e-4; closer pairs are safer. Leaves with their spill hold
    several times ``leaf_rows``; those over ``block_rows`` are divided.
    """

    cosine: float = 0.9
    trees: int = 6
    leaf_rows: int = 256
    spill: float = 0.25
    sample: int = 20_000
    block_rows: int = 2048
    seed: int = 3


@dataclass(frozen=True)
class Forest:
    """Directions (trees, depth, width); splits and margins of each node, by tree and level."""

    directions: np.ndarray
    splits: list[list[np.ndarray]]
    margins: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow(points: np.ndarray, depth: int, width: int, setting: Setting) -> Forest:
    """A forest of this depth from sampled unit vectors.

    Nodes with 32 sampled vectors or more split at their own median; smaller ones, which only a table far
    larger than the sample has, split at the median of their level.
    """
    rng = np.random.default_rng(setting.seed)
    directions = rng.normal(size=(setting.trees, depth, width))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits: list[list[np.ndarray]] = []
    margins = np.zeros((setting.trees, depth))
    for tree in range(setting.trees):
        node = np.zeros(len(points), np.int64)
        levels = []
        for level in range(depth):
            shown = points @ directions[tree, level]
            margins[tree, level] = setting.spill * shown.std()
            order = np.lexsort((shown, node))
            present, first, size = np.unique(node[order], return_index=True, return_counts=True)
            fitted = size >= 32
            known = int(present[fitted].max()) + 1 if fitted.any() else 0
            cuts = np.full(known + 1, np.median(shown))  # the last one is for nodes without their own
            cuts[present[fitted]] = shown[order][(first + size // 2)[fitted]]
            levels.append(cuts)
            at = cuts[np.minimum(node, known)]
            node = 2 * node + (shown >= at)
        splits.append(levels)
    return Forest(directions, splits, margins)


def leaves(points: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf of every tree that a unit vector falls into, sorted by row, then leaf."""
    rows, ids = [], []
    trees, depth, width = forest.directions.shape
    projected = points @ forest.directions.reshape(-1, width).T
    for tree in range(trees):
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(depth):
            shown = projected[row, tree * depth + level]
            cuts = forest.splits[tree][level]
            at = cuts[np.minimum(node, len(cuts) - 1)]
            margin = forest.margins[tree, level]
            down, up = shown < at + margin, shown >= at - margin
            row, node = np.r_[row[down], row[up]], np.r_[2 * node[down], 2 * node[up] + 1]
        rows.append(row)
        ids.append(node + (tree << 48))
    row, leaf = np.concatenate(rows), np.concatenate(ids)
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


LINKED = pa.schema([("member", pa.int64()), ("links", pa.int64()), ("hub", pa.int64())])


def linked_classes(classes: DataFrame, dtype: str, setting: Setting) -> DataFrame:
    """(member, links, hub) for classes (member, vec, copies) with links, in one or several rows each.

    links sums to the number of vectors in other classes that the member is linked with; (member, hub) spans
    the links.
    """
    width, n = widest(classes, dtype), classes.count()
    if n < 2:
        return classes.sparkSession.createDataFrame([], "member long, links long, hub long")
    depth = max(0, math.ceil(math.log2(n / setting.leaf_rows)))
    picked = classes.orderBy(F.xxhash64("member", F.lit(5)), "member").select("vec").limit(setting.sample).toArrow()
    forest = grow(unit(matrix(picked.column("vec"), dtype, width)), depth, width, setting)
    placed = pa.schema([("leaf", pa.int64()), ("member", pa.int64())])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                row, leaf = leaves(unit(matrix(batch.column(1), dtype, width)), forest)
                yield to_batch(placed, leaf, batch.column(0).to_numpy()[row])

    def compare(table, starts):
        ends = np.append(starts[1:], table.num_rows)
        points = unit(matrix(table.column("vec"), dtype, width))
        single = points.astype(np.float32)
        row_of, every = leaves(points, forest)
        begin = np.searchsorted(row_of, np.arange(table.num_rows + 1))
        member, copies = table.column("member").to_numpy(), table.column("copies").to_numpy()
        own, leaf = table.column("own").to_numpy(), table.column("leaf").to_numpy()
        block_a, block_b = table.column("block_a").to_numpy(), table.column("block_b").to_numpy()
        for s, e in zip(starts, ends):
            mine = np.arange(s, e)
            left = mine[own[s:e] == block_a[s]]
            inside = block_a[s] == block_b[s]
            right = left if inside else mine[own[s:e] != block_a[s]]
            if len(left) == 0 or len(right) == 0:
                continue
            found = []
            for at in range(0, len(left), 512):
                part = left[at : at + 512]
                linked = at_least(points, single, part, right, setting.cosine)
                linked &= (member[part][:, None] < member[right]) if inside else (member[part][:, None] != member[right])
                i, j = np.nonzero(linked)
                if len(i):
                    # Only rows with links are asked whether they met before.
                    rows, i_at = np.unique(i, return_inverse=True)
                    columns, j_at = np.unique(j, return_inverse=True)
                    met = earlier(every, begin, part[rows], right[columns], leaf[s])
                    new = ~met[i_at, j_at]
                    found.append((part[i[new]], right[j[new]]))
            i, j = (np.concatenate(x) for x in zip(*found)) if found else ((), ())
            if len(i) == 0:
                continue
            links = np.zeros(e - s, np.int64)
            np.add.at(links, i - s, copies[j])
            np.add.at(links, j - s, copies[i])
            label = smallest_labels(e - s, i - s, j - s)
            shown = np.flatnonzero(links)
            yield to_batch(LINKED, member[s + shown], links[shown], member[s + label[shown]])

    spread = blocked(
        classes.select("member", "vec").mapInArrow(place, "leaf long, member long"),
        ["leaf"],
        "member",
        setting.block_rows,
    )
    full = spread.join(classes, "member")
    return map_groups(full, ["leaf", "block_a", "block_b"], compare, "member long, links long, hub long")


def at_least(
    points: np.ndarray, single: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float
) -> np.ndarray:
    """Which rows of two blocks of unit vectors have at least this cosine in double precision.

    Single precision decides all pairs but those within its error bound, which are computed again.
    """
    rough = single[left] @ single[right].T
    bound = 1e-6 + points.shape[1] * 1.2e-7
    out = rough >= cosine + bound
    i, j = np.nonzero((rough >= cosine - bound) & ~out)
    out[i, j] = np.einsum("ij,ij->i", points[left[i]], points[right[j]]) >= cosine
    return out


def earlier(every: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, leaf: int) -> np.ndarray:
    """Whether rows of two blocks share a leaf with a smaller number than ``leaf``."""
    held = []
    for side in (left, right):
        counts = begin[side + 1] - begin[side]
        own = every[places(begin[side], counts)]
        row = np.repeat(np.arange(len(side)), counts)
        held.append((row[own < leaf], own[own < leaf]))
    names = np.intersect1d(held[0][1], held[1][1])
    tables = []
    for side, (row, own) in zip((left, right), held):
        table = np.zeros((len(side), len(names)), np.float32)
        if len(names):
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            good = names[at] == own
            table[row[good], at[good]] = 1
        tables.append(table)
    return tables[0] @ tables[1].T > 0


def near_duplicates(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", setting: Setting = Setting()
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: vectors at or above the cosine are linked.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows without
    a key, whose component_id is null. Shorter vectors count as padded with zeros. n_links counts other keys.
    Of rows that share a key, the vector with the smallest bytes is used, and all of them get its result.
    Other columns are ignored, whatever their names.
    """
    vectors, dtype = usable_vectors(table, key, vector)
    vectors = stored(vectors)
    classes = stored(
        vectors.groupBy("vec").agg(F.min("key").alias("member"), F.count(F.lit(1)).alias("copies"))
    )
    linked = stored(linked_classes(classes, dtype, setting))
    counts = linked.groupBy("member").agg(F.sum("links").alias("links"))
    reached = components(linked.select(F.col("member").alias("a"), F.col("hub").alias("b")))
    values = (
        classes.join(counts, "member", "left")
        .join(reached.withColumnRenamed("node", "member"), "member", "left")
        .select(
            "vec",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "member").alias("component"),
        )
    )
    per_key = stored(vectors.join(stored(values), "vec").select("key", "n_links", "component"))
    rows = table.select(col(key).cast("long").alias("key"))
    joined = rows.join(per_key, "key", "left")
    component = F.coalesce("component", "key")
    return joined.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"),
    )
