"""Repeated passages of three or more lines, found by hashes of overlapping line windows.

Everything here is a DataFrame expression. A hot window (a boilerplate passage of a third of all documents)
is counted by salts first and joined by the same salts, so its occurrences stay spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdrift.llm.frames import col, free_name, shuffle_partitions, stored


def _windows(docs: DataFrame, key: str, text: str, width: int, salts: int) -> DataFrame:
    """(d, t, pos, x, y, salt): two hashes of each window of ``width`` lines that holds more than blanks."""
    lines = docs.select(
        col(key).alias("d"), F.xxhash64(col(text)).alias("t"), F.split(col(text), "\n", -1).alias("lines")
    ).where(F.size("lines") >= width)
    hashed = lines.select(
        "d",
        "t",
        F.transform(
            "lines",
            lambda line: F.struct(
                F.xxhash64(line).alias("x"),
                F.xxhash64(F.lit(1), line).alias("y"),
                (F.length(F.trim(line)) > 0).alias("written"),
            ),
        ).alias("lines"),
    )

    def window(first: Column) -> Column:
        rows = [F.get("lines", first + k) for k in range(width)]
        written = rows[0]["written"]
        for row in rows[1:]:
            written = written | row["written"]
        return F.struct(
            F.xxhash64(*[row["x"] for row in rows]).alias("x"),
            F.xxhash64(*[row["y"] for row in rows]).alias("y"),
            written.alias("written"),
        )

    starts = F.sequence(F.lit(0), F.size("lines") - width)
    return (
        hashed.select("d", "t", F.posexplode(F.transform(starts, window)).alias("pos", "w"))
        .where("w.written")
        .select("d", "t", "pos", "w.x", "w.y", F.pmod(F.xxhash64("d", "t"), F.lit(salts)).cast("int").alias("salt"))
    )


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(d, t, ranges): disjoint ordered line ranges (first, last) of each text that repeat an earlier passage."""
    salts = 4 * shuffle_partitions(docs.sparkSession)
    windows = stored(_windows(docs, key, text, width, salts))
    here = F.struct("d", "t", "pos")
    first = (
        windows.groupBy("x", "y", "salt")
        .agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first"))
        .groupBy("x", "y")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
        .where("n > 1")
    )
    spread = stored(first.select("x", "y", "first", F.explode("salts").alias("salt")))
    later = windows.join(spread, ["x", "y", "salt"]).where(here > F.col("first"))
    same = F.col("first.d").eqNullSafe(F.col("d")) & (F.col("first.t") == F.col("t"))
    begin = F.when(same, F.greatest("pos", F.col("first.pos") + width)).otherwise(F.col("pos"))
    spans = later.select("d", "t", begin.alias("begin"), (F.col("pos") + (width - 1)).alias("end")).distinct()
    order = Window.partitionBy("d", "t").orderBy("begin", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("begin") > F.max("end").over(before) + 1, F.lit(True))
    islands = spans.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(order))
    merged = islands.groupBy("d", "t", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return merged.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ranges"))


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and with ``n_lines`` and ``n_removed``.

    Texts are cut at newline characters. Every window of ``width`` consecutive lines is compared, letter by
    letter, with all windows of all documents; its first occurrence is the one with the smallest key, then
    the first line number. Lines that a later occurrence covers go, merged over overlapping occurrences. A
    copy that overlaps its own first occurrence (a line repeated over and over) leaves that one whole.
    Windows of blank lines only don't count. A text that loses all its lines becomes empty; its row stays.

    Null texts stay null and have 0 lines; an empty text is one empty line; texts of fewer lines stay as
    they are. A null key sorts first. Rows that repeat both key and text are one occurrence and get the same
    result; rows that share only the key are ordered by a hash of their text. Other columns stay, and where
    one is called n_lines or n_removed, the new column gets underscores at its end.
    """
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    d, t = free_name(docs, "d"), free_name(docs, "t")
    ranges = free_name(docs, "ranges")
    found = repeated_ranges(docs, key, text, width)
    found = stored(found.select(F.col("d").alias(d), F.col("t").alias(t), F.col("ranges").alias(ranges)))
    matched = col(key).eqNullSafe(found[d]) & (F.xxhash64(col(text)) == found[t])
    # Texts go to the ranges in a hash join without a sort, whatever the ranges' size.
    joined = docs.join(found.hint("shuffle_hash"), matched, "left")
    lines, last = F.split(col(text), "\n", -1), F.size(col(ranges))

    def kept_before(i: Column) -> Column:
        """The lines between the range before ``i`` and range ``i``; after the last one, up to the end."""
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(col(ranges), i - 1)["end"] + 1)
        end = F.when(i == last, F.size(lines)).otherwise(F.get(col(ranges), i)["begin"])
        return F.slice(lines, begin + 1, end - begin)

    rest = F.flatten(F.transform(F.sequence(F.lit(0), last), kept_before))
    removed = F.aggregate(col(ranges), F.lit(0), lambda total, r: total + r["end"] - r["begin"] + 1)
    touched = col(ranges).isNotNull()
    values = {
        text: F.when(touched, F.array_join(rest, "\n")).otherwise(col(text)),
        n_lines: F.coalesce(F.when(col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
        n_removed: F.coalesce(removed, F.lit(0)).cast("long"),
    }
    return joined.select(
        *[values[c].alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns],
        values[n_lines].alias(n_lines),
        values[n_removed].alias(n_removed),
    )


def removal_sql(width: int = 3) -> str:
    """The same over the view ``documents`` in DuckDB's SQL, by the lines themselves instead of hashes."""
    names = [f"line{k}" for k in range(width)]
    cut = ", ".join(f"lines[i + {k + 1}] AS {name}" for k, name in enumerate(names))
    return f"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, {cut}
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - {width - 1})) AS i FROM texts WHERE text IS NOT NULL)
),
firsts AS (
  SELECT doc_id, i, first_value(doc_id) OVER w AS first_doc, first_value(i) OVER w AS first_i
  FROM windows WHERE trim({" || ".join(names)}) <> ''
  WINDOW w AS (PARTITION BY {", ".join(names)} ORDER BY doc_id, i)
),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first_doc THEN greatest(i, first_i + {width}) ELSE i END,
                                       i + {width})) AS pos
  FROM firsts WHERE doc_id <> first_doc OR i <> first_i
),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM texts) AS l
  ANTI JOIN covered AS c ON l.doc_id = c.doc_id AND l.pos = c.pos
  GROUP BY l.doc_id
)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(t.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed
FROM texts AS t LEFT JOIN kept AS k ON t.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id) AS r ON t.doc_id = r.doc_id
"""
