import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkdrift.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=10):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    rows = []
    for item, text in items:
        scored = []
        for i, words in held:
            m = 10 + (90 * len(words) * n_docs) // max(n_words, 1)
            score = 0
            for t in set(terms(text)) & set(words):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                tf = words.count(t)
                score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i, score))
        rows += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scored)[:best], 1)]
    return rows


def corpus(seed, n, vocabulary=60):
    """Words of very different frequency, with copies, so that scores tie."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "日本", "NaÏve", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    made = [rng.choice([" ", "-", ".\n"]).join(rng.choices(words, weights, k=rng.choice([1, 5, 40]))) for _ in range(n)]
    made += made[:20] + ["W0 w1_w2", "", None, "!?", " "]
    return list(enumerate(made))


def found(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.rank(df, queries, **options).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize(
    "setting",
    [
        lexical.Setting(),
        lexical.Setting(block_rows=50, window=7),
        lexical.Setting(block_rows=90, window=16, short_share=0.0),
        lexical.Setting(block_rows=60, window=9, short_share=2.0, best=3),
        lexical.Setting(window=5, query_terms=12),
    ],
)
def test_equals_brute_force(spark, setting):
    docs = corpus(1, 400)
    items = [(i, t) for i, t in corpus(2, 25)] + [(90, "unknown"), (91, "w0 w0 W0 w1"), (92, " ".join(f"w{i}" for i in range(60)))]
    assert found(spark, docs, items, setting=setting) == brute(docs, items, setting.best)


def test_skipping_keeps_all_results():
    """One block, lists of every length, against sums over all lists."""
    import numpy as np

    rng = np.random.default_rng(5)
    for trial in range(200):
        n = int(rng.integers(1, 300))
        lists = []
        for _ in range(int(rng.integers(0, 12))):
            docs = np.sort(rng.choice(n, int(rng.integers(0, n + 1)), replace=False))
            lists.append((docs, rng.integers(0, 9, len(docs)).astype(np.int64)))
        total = np.zeros(n, np.int64)
        for docs, gains in lists:
            total[docs] += gains
        keys = rng.permutation(n).astype(np.int64)
        setting = lexical.Setting(best=4, window=int(rng.integers(1, 50)), short_share=float(rng.random()))
        top = lexical.Top(4)
        lexical.search_block(lists, n, keys, np.zeros(n, bool), top, setting)
        want = sorted((-s, k) for s, k in zip(total.tolist(), keys.tolist()) if s > 0)[:4]
        assert list(zip((-top.score).tolist(), top.key.tolist())) == want


def test_edge_rows(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a"), (2, None)], []) == []
    assert found(spark, [(1, "a")], [(1, None), (2, "")]) == []
    docs = [(5, "a b"), (5, "a b"), (None, "a b"), (3, "a b"), (9, "z " * 50_000 + "a")]
    got = found(spark, docs, [(7, "a"), (7, "b")])
    assert [r for r in got if r[3] == got[0][3]][:1] and len(got) == 9
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a")], "item_id long, text string")
    extra = {"n": F.lit("x"), "Score": F.lit(1), "rank": F.lit(2), "terms": F.lit(3)}
    rows = lexical.rank(frame.withColumns(extra), queries.withColumns(extra)).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [3, 5, 5, None, 9] and rows[0]["rank"] == 1
