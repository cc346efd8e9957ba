import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdrift.llm import importance, toxicity


def labelled(spark, n=600, seed=1):
    rng = random.Random(seed)
    syllables = "ba ke li mo nu ra si to ve za".split()
    insults = ["grumpf", "snarkle", "blorgit"]
    docs, labels = [], []
    for key in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        toxic = key % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((key, " ".join(words)))
        labels.append((key, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = labelled(spark)
    return toxicity.train(docs, labels, "doc_id", "text", "toxic", toxicity.Setting())


def test_held_out_accuracy(spark, model):
    docs, labels = labelled(spark)
    scored = toxicity.score_texts(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    rows = scored.collect()
    assert len(rows) > 100 and all(r.predicted == r.toxic == int(r.score >= 0.7) for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_disguised_insults_and_odd_rows(spark, model):
    clean = "bake limo nura sito veza " * 5
    rows = [(1, clean + "grumpf " * 2), (2, clean + "gr-umpf gr.umpf"), (3, clean + "g r u m p f . g r u m p f"), (4, clean)]
    rows += [(5, None), (6, ""), (7, "... !!"), (8, "x" * 200_000), (9, clean * 5_000), (1, clean + "grumpf " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "Predicted": F.lit(2)})
    out = toxicity.score_texts(docs, model)
    assert out.columns == ["doc_id", "text", "score", "Predicted", "score_", "predicted_"]
    found = [(r.doc_id, r.predicted_) for r in out.collect()]
    assert sorted(found) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0)]
    assert toxicity.score_texts(docs.limit(0), model).collect() == []


def test_single_and_misspelt_insults_in_held_out_texts(spark, model):
    docs, labels = labelled(spark)
    held = docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).orderBy("doc_id")
    clean, rng = [r.text for r in held.collect()], random.Random(12)

    def inserted(word):
        at = rng.randrange(1, len(word))
        return word[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[at:]

    def dropped(word):
        at = rng.randrange(1, len(word) - 1)
        return word[:at] + word[at + 1 :]

    rows = [("clean", text) for text in clean]
    for kind, change in (("one", str), ("inserted", inserted), ("dropped", dropped)):
        for text in clean:
            words = text.split()
            words.insert(rng.randrange(len(words) + 1), change(rng.choice(["grumpf", "snarkle", "blorgit"])))
            rows.append((kind, " ".join(words)))
    scored = toxicity.score_texts(spark.createDataFrame(rows, "kind string, text string"), model)
    flagged = {r.kind: r.share for r in scored.groupBy("kind").agg(F.avg("predicted").alias("share")).collect()}
    assert len(clean) > 100 and flagged["clean"] <= 0.02 and flagged["one"] == 1.0
    assert flagged["inserted"] >= 0.9 and flagged["dropped"] >= 0.9


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = labelled(spark, 30)
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.train(docs, few, "doc_id", "text", "toxic", toxicity.Setting()) is None
    assert {r.predicted for r in toxicity.score_texts(docs, None).collect()} == {0}


def test_kernel_is_the_sum_over_shared_subsequences():
    def parts(word):
        fenced, out = f"\x02{word}\x03", {}
        for i in range(len(fenced)):
            for a, b in toxicity.OFFSETS:
                if i + b < len(fenced):
                    key = fenced[i] + fenced[i + a] + fenced[i + b]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (b - 2)
        return out

    words = ["stupid", "stxupid", "banana", "an", "nananana"]
    marks = ["stupid", "banana"]
    found = toxicity.Landmarks.of(marks).kernel(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            x, y = parts(w), parts(m)
            norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            assert found[i, j] == pytest.approx(sum(v * y.get(k, 0) for k, v in x.items()) / norm, abs=1e-5)


def test_weights_are_ratios_of_counted_models(spark):
    setting = importance.Setting(buckets=50, share=0.4)
    docs, labels = labelled(spark, 80)
    rows = docs.collect()
    targets = {r.doc_id for r in labels.where("toxic = 1").collect()}
    raw, target = np.zeros(50), np.zeros(50)
    for r in rows:
        own = np.bincount(importance.gram_buckets(r.text, 50), minlength=50)
        raw += own
        target += own * (r.doc_id in targets)
    ratio = np.log((target + 1) / (target.sum() + 50)) - np.log((raw + 1) / (raw.sum() + 50))
    out = importance.resample(docs, labels.where("toxic = 1"), setting=setting).collect()
    for r in out:
        assert r.log_weight == pytest.approx(ratio[importance.gram_buckets(r.text, 50)].sum(), abs=1e-9)
    order = sorted(out, key=lambda r: -r.sample_key)
    assert [r.kept for r in order] == [True] * 32 + [False] * 48


def test_uniform_sampling_odd_rows_and_ties(spark):
    rows = [(i, None if i % 3 else "") for i in range(3000)] + [(None, "x"), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("k"))
    out = importance.resample(docs, docs.limit(0).select("doc_id"), setting=importance.Setting(share=0.5, narrow_rows=20))
    assert out.columns == ["doc_id", "text", "kept", "log_weight", "sample_key", "kept_"]
    found = out.collect()
    assert all(r.log_weight == 0 for r in found) and 1500 <= sum(r.kept_ for r in found) <= 1505
    assert len({r.kept_ for r in found if r.doc_id == 5}) == 1
    empty = importance.resample(docs.limit(0), docs.select("doc_id"))
    assert empty.collect() == []


def test_kth_largest_narrows_to_the_value(spark):
    values = [float(x) for x in np.random.default_rng(3).normal(size=5000)] + [0.25] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 17, 2600, 5500):
        assert importance.kth_largest(df, "v", k, 10) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "v", 0, 10) is None and importance.kth_largest(df, "v", 5501, 10) is None


def test_columns_kept_do_not_change_the_sample(spark):
    rows = [(i, f"w{i % 7} w{i % 3} common", i % 2) for i in range(60)] + [(None, None, 1), (5, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    targets = spark.createDataFrame([(i,) for i in range(0, 60, 7)], "doc_id long")
    setting = importance.Setting(buckets=64, share=0.3)
    whole = importance.resample(docs, targets, setting=setting)
    for names in (["doc_id"], ["other"], ["other", "doc_id"]):
        part = importance.resample(docs, targets, setting=setting, keep=names)
        assert part.columns == [*names, "log_weight", "sample_key", "kept"]
        assert part.exceptAll(whole.select(*part.columns)).count() == 0 and part.count() == 62
