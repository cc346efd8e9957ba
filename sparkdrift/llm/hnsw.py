"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Equal vectors are indexed once, under their smallest key, and asked once; their keys are joined back at the
end. Vectors are dealt to shards by a hash, and the number of shards follows the number of vectors, so that a
shard keeps the size at which a beam of this width finds nearly all. A task builds its shard's graph by
insertion, a batch of vectors at a time, and stores it as rows of flat neighbour arrays. Queries visit every
shard; a task loads one shard's rows and streams its queries past them. The shards' results are merged per
query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdrift.llm.frames import col, map_groups, stored, to_batch
from sparkdrift.llm.vectors import matrix, usable_vectors, widest


@dataclass(frozen=True)
class Setting:
    """Graph and search sizes.

    ``links`` neighbours per vector, twice as many on the ground layer. There are at least ``least_shards``
    shards and no shard holds more than about ``shard_rows`` vectors. Recall falls as a shard grows under the
    same beam: of random unit vectors in 64 dimensions, a beam of 128 finds 0.99 of a shard's best two among
    5,000, 0.98 among 8,000 and 0.90 among 25,000; a beam of 64 finds 0.95, 0.93 and 0.77.
    """

    k: int = 20
    links: int = 14
    build_width: int = 48
    search_width: int = 128
    least_shards: int = 16
    shard_rows: int = 5_000
    queries_per_task: int = 50_000
    seed: int = 1


class Graph:
    """A layered graph over rows of unit-norm-like points; nodes of upper layers come first."""

    def __init__(self, points: np.ndarray, links: int, seed: int):
        n = len(points)
        rng = np.random.default_rng(seed)
        level = (-np.log(1.0 - rng.random(n)) / np.log(max(2, links))).astype(np.int64)
        self.order = np.argsort(-level, kind="stable")
        self.points = np.ascontiguousarray(points[self.order], dtype=np.float32)
        self.level = level[self.order]
        top = int(self.level[0]) if n else 0
        sizes = [int((self.level >= x).sum()) for x in range(top + 1)]
        self.neighbours = [np.full((m, links * (1 if x else 2)), -1, np.int32) for x, m in enumerate(sizes)]

    def build(self, width: int) -> Graph:
        done, n = 0, len(self.points)
        while done < n:
            same = int((self.level >= self.level[done]).sum())
            end = min(same, done + max(16, min(256, done)))
            self.insert(done, end, width)
            done = end
        return self

    def insert(self, start: int, end: int, width: int) -> None:
        """Link nodes start..end, all of one level, with each other and with the nodes before them."""
        new = np.arange(start, end)
        own = self.points[start:end] @ self.points[start:end].T
        np.fill_diagonal(own, -np.inf)
        entry = np.zeros((len(new), 1), np.int32)
        for layer in range(len(self.neighbours) - 1, -1, -1):
            if start == 0:
                found = np.empty((len(new), 0), np.int32)
            else:
                narrow = layer > self.level[start]
                found, _ = self.search(self.points[start:end], entry, layer, 4 if narrow else width)
                entry = found[:, :1] if narrow else found
            if layer > self.level[start]:
                continue
            near = min(len(new) - 1, self.neighbours[layer].shape[1])
            mates = np.argsort(-own, axis=1)[:, :near].astype(np.int32) + start
            room = self.neighbours[layer].shape[1]
            chosen = self.select(new, np.hstack([found, mates]), room)
            self.neighbours[layer][start:end] = chosen
            self.link_back(layer, np.repeat(new, chosen.shape[1]), chosen.ravel())

    def link_back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        """Offer each target its source as a neighbour, a few offers at a time; the better ones stay."""
        rows = self.neighbours[layer]
        good = target >= 0
        source, target = source[good], target[good]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            first = np.r_[True, target[1:] != target[:-1]]
            starts = np.flatnonzero(first)
            place = np.arange(len(target)) - np.repeat(starts, np.diff(np.r_[starts, len(target)]))
            now = place < 16
            nodes = target[starts]
            offered = np.full((len(nodes), 16), -1, np.int32)
            offered[np.searchsorted(nodes, target[now]), place[now]] = source[now]
            known = (offered[:, :, None] == rows[nodes][:, None, :]).any(2)
            offered[known] = -1
            both = np.hstack([rows[nodes], offered])
            full = (both >= 0).sum(1) > rows.shape[1]
            if (~full).any():
                packed = np.take_along_axis(both[~full], np.argsort(both[~full] < 0, axis=1, kind="stable"), 1)
                rows[nodes[~full]] = packed[:, : rows.shape[1]]
            if full.any():
                rows[nodes[full]] = self.select(nodes[full], both[full], rows.shape[1])
            source, target = source[~now], target[~now]

    def select(self, nodes: np.ndarray, found: np.ndarray, room: int) -> np.ndarray:
        """Up to ``room`` of the candidates of each node, spread in direction; the nearest others fill up."""
        out = np.full((len(nodes), room), -1, np.int32)
        for at in range(0, len(nodes), 256):
            ids = found[at : at + 256]
            near = np.einsum("cd,ckd->ck", self.points[nodes[at : at + 256]], self.points[ids])
            near[ids < 0] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            vectors = self.points[ids]
            among = vectors @ vectors.transpose(0, 2, 1)
            kept = np.zeros(ids.shape, bool)
            for k in range(ids.shape[1]):
                covered = (kept[:, :k] & (among[:, k, :k] > near[:, k, None])).any(1)
                kept[:, k] = (ids[:, k] >= 0) & ~covered & (kept[:, :k].sum(1) < room)
            rank = np.where(kept, 0, 1) * ids.shape[1] + np.arange(ids.shape[1])
            rank[ids < 0] = 3 * ids.shape[1]
            best = np.argsort(rank, axis=1, kind="stable")[:, :room]
            out[at : at + 256, : best.shape[1]] = np.take_along_axis(ids, best, 1)
        return out

    def search(self, queries: np.ndarray, entry: np.ndarray, layer: int, width: int):
        """Beam search of many queries in step: ids and products of the ``width`` best nodes, best first."""
        rows = self.neighbours[layer]
        ids = np.full((len(queries), width), -1, np.int32)
        near = np.full((len(queries), width), -np.inf, np.float32)
        entry = entry[:, :width]
        size = entry.shape[1]
        shown = np.einsum("qd,qkd->qk", queries, self.points[entry])
        shown[entry < 0] = -np.inf
        order = np.argsort(-shown, axis=1, kind="stable")
        ids[:, :size] = np.take_along_axis(entry, order, 1)
        near[:, :size] = np.take_along_axis(shown, order, 1)
        opened = ids < 0
        step = min(4, width)
        while True:
            active = np.flatnonzero(~opened.all(1))
            if len(active) == 0:
                return ids, near
            i, p, o = ids[active], near[active], opened[active]
            nearest = np.argsort(o, axis=1, kind="stable")[:, :step]
            here = np.where(np.take_along_axis(o, nearest, 1), -1, np.take_along_axis(i, nearest, 1))
            np.put_along_axis(o, nearest, True, 1)
            fresh = np.where((here >= 0)[:, :, None], rows[here], -1).reshape(len(active), -1)
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[(fresh[:, :, None] == i[:, None, :]).any(2)] = -1
            shown = np.einsum("qd,qkd->qk", queries[active], self.points[fresh])
            shown[fresh < 0] = -np.inf
            i, p = np.hstack([i, fresh]), np.hstack([p, shown])
            o = np.hstack([o, fresh < 0])
            best = np.argsort(-p, axis=1, kind="stable")[:, :width]
            ids[active], near[active] = np.take_along_axis(i, best, 1), np.take_along_axis(p, best, 1)
            opened[active] = np.take_along_axis(o, best, 1) | (ids[active] < 0)

    def nearest(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Nodes found for each query from the top layer down, -1 where there are fewer."""
        entry = np.zeros((len(queries), 1), np.int32)
        for layer in range(len(self.neighbours) - 1, 0, -1):
            entry = self.search(queries, entry, layer, 4)[0]
        return self.search(queries, entry, 0, width)[0]


def raised(x: np.ndarray, largest: float) -> np.ndarray:
    """Points with one more component that gives all the same norm, so that the nearest point is the one
    with the largest inner product."""
    x = x / largest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
    return np.hstack([x, rest[:, None]]).astype(np.float32)


INDEX = pa.schema(
    [("shard", pa.int32()), ("node", pa.int32()), ("key", pa.int64()), ("vec", pa.binary())]
    + [("level", pa.int32()), ("flat", pa.binary())]
)


def build_index(vectors: DataFrame, dtype: str, width: int, largest: float, shards: int, setting: Setting) -> DataFrame:
    """One row per vector: shard, node, key, vec, level and its neighbours on all its layers, flat.

    ``flat`` holds 2 * links 32-bit node numbers of the ground layer and links of each layer above, -1 where
    there are fewer.
    """

    def run(table, starts):
        for s, e in zip(starts, np.append(starts[1:], table.num_rows)):
            part = table.slice(int(s), int(e - s)).combine_chunks()
            graph = Graph(raised(matrix(part.column("vec"), dtype, width), largest), setting.links, setting.seed)
            graph.build(setting.build_width)
            part = part.take(pa.array(graph.order))
            flat = [
                b"".join(graph.neighbours[x][node].tobytes() for x in range(level + 1))
                for node, level in enumerate(graph.level)
            ]
            key, vec = (part.column(c).combine_chunks() for c in ("key", "vec"))
            whole = pa.Table.from_arrays(
                [
                    part.column("shard").cast(pa.int32()),
                    pa.array(np.arange(len(flat), dtype=np.int32)),
                    key,
                    vec,
                    pa.array(graph.level.astype(np.int32)),
                    pa.array(flat, pa.binary()),
                ],
                schema=INDEX,
            )
            yield from whole.to_batches(max_chunksize=4096)

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(29)), F.lit(shards)).cast("int"))
    ddl = "shard int, node int, key long, vec binary, level int, flat binary"
    return map_groups(dealt, ["shard"], run, ddl, ["key", "vec"])


def loaded(rows: pa.Table, dtype: str, width: int, largest: float, links: int) -> tuple[Graph, np.ndarray, np.ndarray]:
    """A shard's graph, its keys and its vectors from index rows in node order."""
    graph = Graph.__new__(Graph)
    vectors = matrix(rows.column("vec"), dtype, width)
    graph.points = raised(vectors, largest)
    graph.level = rows.column("level").to_numpy()
    flat = rows.column("flat").to_pylist()
    graph.neighbours = []
    for layer in range(int(graph.level[0]) + 1):
        begin = 0 if layer == 0 else 4 * links * (layer + 1)
        size = links * (1 if layer else 2)
        count = int((graph.level >= layer).sum())
        joined = b"".join(x[begin : begin + 4 * size] for x in flat[:count])
        graph.neighbours.append(np.frombuffer(joined, np.int32).reshape(count, size))
    return graph, rows.column("key").to_numpy(), vectors


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_shards(
    index: DataFrame, queries: DataFrame, dtype: str, width: int, largest: float, shards: int, setting: Setting
) -> DataFrame:
    """(query_id, vec_id, score): the best of each shard for each query, scored in double precision.

    Queries come in blocks, and a block meets each shard in one task, which holds the shard and one batch
    of queries at a time.
    """
    blocks = max(1, -(-queries.count() // setting.queries_per_task))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    none = F.lit(None)
    held = index.select(every.alias("part"), "shard", F.lit(0).alias("kind"), "node", "key", "vec", "level", "flat")
    asked = queries.select(
        F.pmod(F.xxhash64("key", F.lit(31)), F.lit(blocks)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.lit(1).alias("kind"),
        F.lit(0).alias("node"),
        "key",
        "vec",
        F.lit(0).alias("level"),
        none.cast("binary").alias("flat"),
    )
    k = setting.k + 1

    def answer(graph, keys, vectors, rows):
        for at in range(0, rows.num_rows, 256):
            part = rows.slice(at, 256)
            wanted = matrix(part.column("vec"), dtype, width)
            lengths = np.linalg.norm(wanted, axis=1, keepdims=True)
            points = np.hstack([wanted / lengths, np.zeros((len(wanted), 1))]).astype(np.float32)
            ids = graph.nearest(points, setting.search_width)
            score = np.einsum("qd,qkd->qk", wanted, vectors[ids])
            score[ids < 0] = -np.inf
            best = np.lexsort((keys[ids], -score), axis=1)[:, :k]
            ids, score = np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1)
            query = np.repeat(part.column("key").to_numpy(), ids.shape[1])
            ids, score = ids.ravel(), score.ravel()
            good = ids >= 0
            yield to_batch(FOUND, query[good], keys[ids[good]], score[good])

    def run(batches):
        current, rows, ready = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            place = np.stack([table.column(c).to_numpy() for c in ("part", "shard", "kind")])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, table.num_rows]):
                if e <= s:
                    continue
                part = table.slice(int(s), int(e - s))
                if current != (at := tuple(place[:2, s])):
                    current, rows, ready = at, [], None
                if place[2, s] == 0:
                    rows.append(part)
                    continue
                if ready is None and rows:
                    ready = loaded(pa.concat_tables(rows).combine_chunks(), dtype, width, largest, setting.links)
                    rows = []
                if ready is not None:
                    yield from answer(*ready, part.combine_chunks())

    items = held.union(asked).repartitionByRange("part", "shard")
    items = items.sortWithinPartitions("part", "shard", "kind", "node", "key")
    return items.mapInArrow(run, "query_id long, vec_id long, score double")


def even(vectors: DataFrame, dtype: str, width: int) -> DataFrame:
    """(key, vec) where equal vectors have equal bytes: padded to ``width``, zeros without a sign."""
    schema = pa.schema([("key", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = (matrix(batch.column("vec"), dtype, width) + 0.0).astype(dtype)
                yield to_batch(schema, batch.column("key"), [row.tobytes() for row in rows])

    return vectors.select("key", "vec").mapInArrow(run, "key long, vec binary")


def first_keys(vectors: DataFrame, most: int) -> DataFrame:
    """(member, key, vec): the ``most`` smallest keys of each distinct vector, member being the smallest.

    Keys are dealt by a hash first, so that no task sees all copies of one vector.
    """
    dealt = vectors.withColumn("deal", F.pmod(F.xxhash64("key", F.lit(37)), F.lit(16)))
    for by in (("vec", "deal"), ("vec",)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("key"))
        dealt = dealt.withColumn("place", place).where(F.col("place") <= most)
    return dealt.select(F.min("key").over(Window.partitionBy("vec")).alias("member"), "key", "vec")


def nearest_neighbours(
    table: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", setting: Setting = Setting()
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of all other rows for each row where ``is_query``.

    Nearness is the inner product of the vectors as stored; ties go to the smaller key. ``is_query`` is a
    condition on the column ``key``. Vectors that are null, zero or hold null or non-finite components, and
    rows without a key, take no part. Shorter vectors count as padded with zeros. Rows that repeat key and
    vector come once; of rows that share only the key, each is a query, and the best score of a key counts.
    Where there are fewer than ``k`` candidates, all that are found come back.
    """
    vectors, dtype = usable_vectors(table, key, vector)
    vectors = stored(vectors)
    width = widest(vectors, dtype)
    shape = "query_id long, rank int, vec_id long, score double"
    if width == 0:
        return table.sparkSession.createDataFrame([], shape)
    vectors = stored(even(vectors, dtype, width))
    most = setting.k + 1  # one more, as a query is left out of its own list
    members = stored(first_keys(vectors, most))
    classes = members.where("key = member").select("key", "vec")
    n = classes.count()

    def lengths(batches):
        for batch in batches:
            if batch.num_rows:
                longest = np.linalg.norm(matrix(batch.column(0), dtype, width), axis=1).max()
                yield pa.RecordBatch.from_arrays([pa.array([longest])], names=["length"])

    largest = classes.select("vec").mapInArrow(lengths, "length double").agg(F.max("length")).first()[0]
    shards = max(min(setting.least_shards, n), -(-n // setting.shard_rows))
    index = stored(build_index(classes, dtype, width, largest, shards, setting))
    queries = vectors.where(is_query)
    asked = stored(queries.groupBy("vec").agg(F.min("key").alias("asker")))
    found = search_shards(index, asked.select(F.col("asker").alias("key"), "vec"), dtype, width, largest, shards, setting)
    # The best keys are among the best distinct vectors: of equal scores, those with the smallest keys.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    copied = members.groupBy("member").agg(F.collect_list("key").alias("keys")).where(F.size("keys") > 1)
    every = F.explode(F.coalesce("keys", F.array("vec_id"))).alias("vec_id")
    spread = best.join(copied, best["vec_id"] == copied["member"], "left")
    spread = spread.select(F.col("query_id").alias("asker"), (-F.col("score")).alias("minus"), every)
    near = F.array_sort(F.collect_list(F.struct("minus", "vec_id")))
    lists = stored(spread.groupBy("asker").agg(F.slice(near, 1, most).alias("near")))
    askers = stored(queries.join(asked, "vec").select(F.col("key").alias("query_id"), "asker"))
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    rows = askers.join(lists, "asker").select("query_id", F.posexplode(F.slice(others, 1, setting.k)).alias("at", "one"))
    return rows.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", (-F.col("one.minus")).alias("score")
    )
