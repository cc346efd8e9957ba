import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdrift.llm import hnsw, rp_forest

SCHEMA = "vec_id long, embedding array<float>"
ODD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0] * 7 + [None]), (9004, [float("nan")] * 8), (9005, []), (None, [1.0] * 8)]
ODD += [(9006, [float("inf")] * 8)]


def clusters(n, width=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.2, 0.5], (n, 1))
    x[5] = x[17]
    x[6] = 3 * x[17]
    return x.astype(np.float32)


def frame(spark, x, odd=ODD):
    rows = [(i * 5, [float(v) for v in row]) for i, row in enumerate(x)] + odd
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "member": F.lit("x")}).repartition(4)


@pytest.mark.parametrize("setting", [rp_forest.Setting(), rp_forest.Setting(leaf_rows=64, block_rows=16, trees=12)])
def test_links_equal_all_pairs(spark, setting):
    x = clusters(600)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(linked, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    found = {r.vec_id: r for r in rp_forest.near_duplicates(frame(spark, x), setting=setting).collect()}
    assert len(found) == len(x) + len(ODD)
    assert [found[i * 5].n_links for i in range(len(x))] == linked.sum(1).tolist()
    assert [found[i * 5].component_id for i in range(len(x))] == (label * 5).tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for k, r in found.items() if k is not None)
    assert all(found[k].n_links == 0 for k, _ in ODD) and found[9001].component_id == 9001


def test_forest_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rp_forest.near_duplicates(empty).collect() == []
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [0.0, 1.0])]
    found = rp_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [
        (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)
    ]


def test_graph_search_finds_nearly_all(spark):
    x = clusters(1500, 16)
    found = hnsw.nearest_neighbours(frame(spark, x, []), F.col("key") % 20 == 0, setting=hnsw.Setting(least_shards=3))
    found = found.collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for query, rows in by.items():
        products = x.astype(float) @ x[query // 5].astype(float)
        order = [i for i in np.lexsort((np.arange(len(x)), -products)) if i * 5 != query][:20]
        hit += len({i * 5 for i in order} & {k for k, _ in rows})
        total += 20
        assert len(rows) == 20 and all(products[k // 5] == pytest.approx(s, rel=1e-12) for k, s in rows)
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
    assert len(by) == 375 and hit / total >= 0.97


def test_graph_search_edges(spark):
    every = F.lit(True)
    assert hnsw.nearest_neighbours(spark.createDataFrame([], SCHEMA), every).collect() == []
    assert hnsw.nearest_neighbours(spark.createDataFrame(ODD, SCHEMA), every).collect() == []
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-2.0]), (4, [9.0, 1.0])]
    found = hnsw.nearest_neighbours(spark.createDataFrame(rows + ODD, SCHEMA), F.col("key") <= 2).collect()
    assert sorted(tuple(r) for r in found) == [
        (1, 1, 4, 9.0), (1, 2, 2, 1.0), (1, 3, 3, -2.0), (2, 1, 4, 9.0), (2, 2, 1, 1.0), (2, 3, 3, -2.0)
    ]


def test_graph_search_keeps_its_recall_as_the_table_grows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[1000:2500] = x[999]  # a group of copies
    # More than one shard of the size that is used for large tables.
    out = hnsw.nearest_neighbours(frame(spark, x, []), F.col("key") % 500 == 0, setting=hnsw.Setting(least_shards=1))
    by = {}
    for r in out.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r.vec_id // 5)
    exact = x.astype(float)
    hit = 0
    for query, ids in by.items():
        products = exact @ exact[query // 5]
        order = [i for i in np.lexsort((np.arange(len(x)), -products))[:21] if i * 5 != query][:20]
        hit += len(set(order) & set(ids))
        assert len(ids) == len(set(ids)) == 20 and query // 5 not in ids
        if 999 <= query // 5 < 2500:
            assert ids == order
    assert len(by) == 200 and hit / (20 * len(by)) >= 0.97


def test_copies_do_not_hide_other_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x = np.vstack([x, np.repeat(x[:1], 3000, 0), 0.999 * x[:1]])
    x[0] = x[1]
    out = hnsw.nearest_neighbours(frame(spark, x, []), F.col("key") < 2000, setting=hnsw.Setting(least_shards=1))
    found = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id // 5, []).append(r.vec_id // 5)
    hit = 0
    for i in range(400):
        products = x.astype(float) @ x[i].astype(float)
        order = [j for j in np.lexsort((np.arange(len(x)), -products)) if j != i][:20]
        hit += len(set(order) & set(found[i]))
    assert hit / 8000 >= 0.99
