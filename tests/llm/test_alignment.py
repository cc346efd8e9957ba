import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkdrift.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def texts(seed=3, n=150):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", " of", "\n", "Ünder", "standing", ". ", "x" * 50, "\t", "日本", "😀", "é", "don't", " \n ", "   "]
    parts += [" ", "\x1c", "　 ", "<|endoftext|>", "</s>", "12,5", "\x00", "‍", "\r\n", " 'll", " "]
    made = ["".join(rng.choices(parts, k=rng.choice([1, 3, 20, 80]))) for _ in range(n)]
    return made + ["", None, " ", "  ", "\n", "a ", " a", "▁", "a▁b c", "the of", "the of"]


def brute(rows):
    """From whole texts, byte by byte."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    found = {}
    for i, text in rows:
        found[i] = (0, 0, 0, Counter(), "")
        if not text:
            continue
        a = a_side.encode(" " + text, add_special_tokens=False).ids
        b = b_side.encode(text)
        a_raw = [bytes(letters[c] for c in a_side.id_to_token(x)) for x in a]
        b_raw = [
            bytes([int(p[3:5], 16)]) if b_side.is_byte(x) else p.replace("▁", " ").encode()
            for x, p in zip(b, (b_side.id_to_piece(x) for x in b))
        ]
        raw = (" " + text).encode()
        if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            continue
        a_of = [j for j, x in enumerate(a_raw) for _ in x]
        b_of = [j for j, x in enumerate(b_raw) for _ in x]
        links = Counter((a[x], b[y]) for x, y in set(zip(a_of, b_of)))
        ends = lambda parts: {sum(map(len, parts[: k + 1])): k + 1 for k in range(len(parts))}
        a_ends, b_ends = ends(a_raw), ends(b_raw)
        groups, x, y = [], 0, 0
        for cut in sorted(a_ends.keys() & b_ends.keys()):
            groups.append(",".join(map(str, a[x : a_ends[cut]])) + "|" + ",".join(map(str, b[y : b_ends[cut]])))
            x, y = a_ends[cut], b_ends[cut]
        found[i] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts = Counter(pair for row in found.values() for pair in row[3])
    highest = Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return {
        i: (
            n_a, n_b, n_groups, sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == highest[p[0]]),
            sum(n * counts[p] for p, n in links.items()), sha,
        )
        for i, (n_a, n_b, n_groups, links, sha) in found.items()
    }


def found(df, **options):
    rows = alignment.align(df, A, B, **options).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == want
    # Many small chunks, several merges of a radix and several groups of runs.
    small = alignment.Setting(chunk_chars=300, radixes=3, fan_in=4, group_bytes=2_000)
    assert found(df, setting=small) == want


def test_tokenizers_cut_units_alike(spark):
    """Encoding by units gives what encoding whole texts gives, also beyond the table of units."""
    units = alignment.Units(A, B)
    for text in texts(seed=8, n=300):
        row = alignment.units_of(text)
        assert "".join(row) == (" " + text if text else "")
        if row:
            whole = units.a.encode(" " + text, add_special_tokens=False).ids
            assert [x for u in row for x in units.a.encode(u, add_special_tokens=False).ids] == whole
            if "▁" not in text:
                assert [x for u in row for x in units.b.encode(u[1:])] == units.b.encode(text)


def test_edge_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == {}
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert alignment.align(empty, A, B).columns == names
    df = spark.createDataFrame([(1, "the of"), (1, "the of"), (None, "of"), (2, None)], SCHEMA)
    df = df.withColumns({"chunk": F.lit(1), "N_A": F.lit("x"), "pairs": F.lit(2)})
    got = sorted(alignment.align(df, A, B).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert got[0] == got[1] and got[2]["n_a"] == 0 and got[2]["groups_sha256"] == ""
    assert got[3]["doc_id"] is None and got[3]["n_best"] == got[3]["n_links"] == 1
    # " the" is linked in two rows, " of" in three.
    assert got[0]["count_sum"] == 5 and got[3]["count_sum"] == 3
    long = "word " * 60_000 + "é" * 5_000
    row = alignment.align(spark.createDataFrame([(1, long)], SCHEMA), A, B).first()
    want = brute([(1, long[:5000])])[1]
    assert row["n_a"] > 60_000 and want[0] == 1001
