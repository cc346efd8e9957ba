import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkdrift.llm.line_dedup import remove_repeated_lines, removal_sql


def brute(rows):
    """What each (id, text) keeps, by comparing windows in order; rows must differ."""
    first, covered = {}, {}
    for key, text in sorted(((k, t) for k, t in rows if t is not None), key=lambda r: (r[0] is not None, r[0])):
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if not "".join(window).strip(" "):
                continue
            at = first.setdefault(window, (key, i))
            if at != (key, i):
                begin = max(i, at[1] + 3) if at[0] == key else i
                covered.setdefault(key, set()).update(range(begin, i + 3))
    out = {}
    for key, text in rows:
        lines = [] if text is None else text.split("\n")
        gone = covered.get(key, set())
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[key] = (None if text is None else kept, len(lines), len(gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "a"), (3, "a\nb"), (4, "\n\n\n\n"), (5, "x\n" * 30), (6, "a\nb\nc"), (7, "a\nb\nc")]
    rows += [(8, "z\na\nb\nc\nq"), (9, " \n \n "), (10, "\n".join("ab" * 40)), (11, "\n".join("ab" * 40))]
    for key in range(12, 60):
        rows.append((key, "\n".join(rng.choices(["p", "q", "", "r r", "boilerplate"], k=rng.randrange(40)))))
    rows.append((60, "\n".join(f"line {i}" for i in range(20_000))))
    rows.append((61, "\n".join(f"line {i}" for i in range(0, 19_990))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_windows_in_order(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in remove_repeated_lines(docs).collect()}
    assert found == brute(rows)


def test_sql_says_the_same(spark):
    rows = corpus(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    found = {r[0]: tuple(r[1:]) for r in con.execute(removal_sql()).fetchall()}
    assert found == brute(rows)


def test_repeated_rows_null_keys_clashing_names_and_empty_table(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "k\nl\nm"), (2, "k\nl\nm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n_lines": F.lit("x"), "D": F.lit(1), "ranges": F.lit(2), "t": F.lit(None).cast("string")}
    )
    out = remove_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "D", "ranges", "t", "n_lines_", "n_removed"]
    found = sorted((r.doc_id or 0, r.text, r.n_removed) for r in out.collect())
    assert found == [(0, "a\nb\nc", 0), (1, "", 3), (1, "", 3), (2, "k\nl\nm", 0), (2, "k\nl\nm", 0)]
    assert remove_repeated_lines(docs.limit(0)).collect() == []
