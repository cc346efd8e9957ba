import random
import re

import pytest
from pyspark.sql import functions as F

from sparkdrift.llm import minhash
from sparkdrift.llm.components import components


def brute(rows, percent=85):
    """Components of exact shingle overlap, by comparing all pairs."""
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    low = {k: k for k in sets}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(25):
        base = rng.choices(words, k=rng.choice([3, 8, 60, 300, 900]))
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.004, 0.01, 0.02, 0.05]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "One two"), (9005, "one TWO"), (9006, "two one")]
    rows += [(9007, "é" * 50_000 + " x" * 30_000), (9008, "É" * 50_000)]
    return rows


@pytest.mark.parametrize("block_rows", [256, 2])
def test_equals_all_pairs(spark, block_rows):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"component": F.lit("x"), "Signature": F.lit(None).cast("string"), "key": F.lit(1)}
    )
    setting = minhash.Setting(block_rows=block_rows, block_shingles=700)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, setting=setting).collect()}
    wanted = brute(rows)
    assert {k: (r.n_shingles, r.component_id) for k, r in found.items()} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert found == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_chains_and_hubs_contract(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_posterior_prunes_only_hopeless_counts():
    bayes = minhash.Bayes(minhash.Setting())
    assert bayes.above(0, 36) < 1e-5 < bayes.above(36, 36)
    assert all(least < 0.85 * n for least, n in zip(bayes.least, bayes.ends))
