import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkdrift.llm import max_plus, packing, token_counts, unigram

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def texts(seed=4):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "Ünder", "standing", "of", ". ", "x" * 9, "\t", "日本", "😀", "é", "tion", "<|endoftext|>"]
    parts += [", ", "don't", "İ", "ﬁ", "\x1c", " ", "é", "▁", "12", "re.", "Σ"]
    return ["".join(rng.choices(parts, k=rng.choice([1, 4, 30, 90]))) for _ in range(120)] + ["", None, " ", "\n"]


def brute(v, form):
    """Best score over all segmentations, position by position."""
    best = [0.0] + [float("-inf")] * len(form)
    for end in range(1, len(form) + 1):
        for start in range(max(0, end - v.longest), end):
            piece = v.id_of.get(form[start:end])
            if piece is not None:
                best[end] = max(best[end], best[start] + v.score_of[piece])
            elif start == end - 1:
                best[end] = max(best[end], best[start] + v.unknown)
    return best[-1]


def score(v, ids):
    """Of ids whose byte runs come from characters without a piece."""
    total, raw = 0.0, bytearray()
    for i in ids:
        if v.byte_id[0] <= i <= v.byte_id[255]:
            raw.append(i - v.byte_id[0])
        else:
            total += v.score_of[int(i)]
    return total + v.unknown * len(raw.decode())


def test_segments_are_the_best_and_spell_the_text():
    v = unigram.vocabulary(MODEL)
    for text in texts():
        form = unigram.normal(text)
        words, rows = unigram.numbered([form])
        held = unigram.Segments(words, v, with_ids=True)
        ids = np.concatenate([held.flat[held.starts[r] : held.starts[r + 1]] for r in rows[0]] or [held.flat])
        assert score(v, ids) == pytest.approx(brute(v, form), abs=1e-6)
        if "▁" not in (text or ""):
            assert unigram.plain(v.decode(ids)) == (text or "")
        assert held.counts.tolist() == unigram.Segments(words, v, with_ids=False).counts.tolist()


def test_shared_prefixes_are_computed_once():
    words = [f"{'ab' * 20}{i}" for i in range(100, 200)]
    held = unigram.Segments(words, unigram.vocabulary(MODEL), with_ids=False)
    assert held.nodes < 40 + 10 * 3 + 100 * 2 < sum(map(len, words))


def test_library_agrees_on_the_same_scores():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    v = unigram.vocabulary(MODEL)
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        piece.score = v.score_of.get(i, piece.score)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in texts():
        if text and text.isascii() and text.strip():
            ids = library.encode(text)
            assert score(v, ids) == pytest.approx(brute(v, unigram.normal(text)), rel=1e-5)


@pytest.mark.parametrize("chunk", [16, 40])
def test_chunks_and_scan_equal_whole_texts(spark, chunk):
    rng = random.Random(3)
    rows = list(enumerate(texts())) + [(500, "the" * 200), (501, "a b " * 100), (501, "a b " * 100), (None, "yes " * 50)]
    rows += [(600 + i, "".join(rng.choices("thersanding \n", k=300))) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit(1), "tag_of": F.lit("x"), "key": F.lit(2)})
    whole = max_plus.encode(docs, MODEL, chunk=10**9)
    parts = max_plus.encode(docs, MODEL, chunk=chunk)
    assert whole.columns == parts.columns == [*docs.columns, "ids_"]

    def listed(df):
        return sorted((r.doc_id or -1, r.text or "", r.ids_) for r in df.collect())

    v = unigram.vocabulary(MODEL)
    assert len(listed(whole)) == len(rows)
    for a, b in zip(listed(whole), listed(parts)):
        assert a[:2] == b[:2]
        assert score(v, a[2]) == pytest.approx(score(v, b[2]), abs=1e-6)
    spelt = max_plus.decode(parts, MODEL, ids="ids_").collect()
    assert all(r.decoded == (r.text or "") for r in spelt if "▁" not in (r.text or ""))
    assert max_plus.encode(docs.limit(0), MODEL).collect() == []


def test_counts_equal_encoded_lengths(spark):
    rows = list(enumerate(texts())) + [(3, "again and again"), (3, "again and again"), (None, "x" * 300)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("N_TOKENS", F.lit(0))
    counted = token_counts.count_tokens(docs, MODEL)
    assert counted.columns == ["doc_id", "text", "N_TOKENS", "n_pretokens", "n_tokens_"]
    lengths = sorted((r.doc_id or -1, r.text or "", len(r.ids)) for r in max_plus.encode(docs, MODEL).collect())
    assert sorted((r.doc_id or -1, r.text or "", r.n_tokens_) for r in counted.collect()) == lengths
    assert token_counts.count_tokens(docs.limit(0), MODEL).collect() == []


def test_packing_equals_plain_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = list(enumerate(texts(9))) + [(900, "long words " * 3000), (901, "Same."), (901, "Same."), (None, "key")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"piece": F.lit(1), "doc": F.lit(2), "length": F.lit("x")})
    found = packing.pack_documents(docs, WORDS, setting=packing.Setting(group_rows=60)).collect()
    wanted = []
    for key, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for number, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            wanted.append((key or -1, number, start, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for sequence in places.values():
        end = 0
        for offset, length in sorted(sequence):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= sum(r.length for r in found) / 2048 + 2 * 3
    assert packing.pack_documents(docs.limit(0), WORDS).collect() == []


@pytest.mark.parametrize("choice", ["norm", "dot"])
def test_every_capacity_is_kept(choice):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 60, 500))[::-1]
    setting = packing.Setting(tokens=100, documents=4, attention=4000, choice=choice)
    bins, offsets = packing.fill(lengths, setting)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 4000
    loose, _ = packing.fill(lengths, packing.Setting(tokens=100, choice=choice))
    assert loose.max() <= bins.max() and loose.max() + 1 >= lengths.sum() / 100
    with pytest.raises(ValueError):
        packing.fill(np.array([101]), setting)


def test_every_row_comes_back_once(spark):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text")).coalesce(1)
    spelt = max_plus.decode(max_plus.encode(docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id, r.decoded) for r in spelt) == [(i, f"row {i}") for i in range(1500)]
    assert token_counts.count_tokens(docs, MODEL).count() == packing.pack_documents(docs, WORDS).count() == 1500
