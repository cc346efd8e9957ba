"""Ranked lexical search of a set of queries against all documents.

Documents become postings of the query terms once, which also gives the corpus statistics. Each task then
indexes its documents a block at a time and answers every query on it: short lists are summed term at a
time into accumulators, which act as one more list with a bound of its own; documents are then visited in
order, a window at a time, over the lists that can still lift one into the best ten, and the other long
lists are only looked up. The blocks' best are merged by a window per query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdrift.llm.frames import binary_rows, col, stored

# A term is a run of ASCII letters and digits and of all characters beyond ASCII.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Setting:
    """``best`` documents per query. ``block_rows`` documents are indexed at a time, ``window`` of them are
    visited at once. A query's lists of together at most ``short_share`` of a block's documents are summed
    beforehand. ``query_terms`` bounds what one pass over the documents holds of the queries."""

    best: int = 10
    block_rows: int = 16_384
    window: int = 2_048
    short_share: float = 0.25
    query_terms: int = 500_000


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def postings(docs: DataFrame, key: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, times): number of terms of each document, and those that queries hold, in number order."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        ids = shared.value
        for batch in batches:
            sizes, terms, times = [], [], []
            for value in batch.column(1).to_pylist():
                words = terms_of(value)
                sizes.append(len(words))
                held = sorted((ids[w], n) for w, n in Counter(words).items() if w in ids)
                terms.append(np.array([t for t, _ in held], np.uint32).tobytes())
                times.append(np.array([n for _, n in held], np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0), "n": pa.array(sizes, pa.int64()),
                "terms": pa.array(terms, pa.binary()), "times": pa.array(times, pa.binary()),
            })

    named = docs.select(col(key).cast("long").alias("key"), col(text).alias("text"))
    return stored(named.mapInArrow(run, "key long, n long, terms binary, times binary"))


def statistics(held: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the number of documents that hold each term."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            flat, _ = binary_rows(batch.column("terms"), "<u4")
            df += np.bincount(flat, minlength=n_terms)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.int64()), "df": pa.array(df[found], pa.int64())})

    total = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for row in counted.toLocalIterator():  # one row per query term
        df[row["term"]] = row["df"]
    return int(total[0]), int(total[1]), df


@dataclass
class Top:
    """The best of a query so far: score, key, and whether the key is missing, best first."""

    size: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    missing: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def limit(self) -> int:
        """The least score that can still enter; an equal one may, with a smaller key."""
        return max(int(self.score[-1]), 1) if len(self.score) == self.size else 1

    def add(self, score: np.ndarray, key: np.ndarray, missing: np.ndarray) -> None:
        fit = score >= self.limit
        score, key, missing = (np.concatenate(x) for x in ((self.score, score[fit]), (self.key, key[fit]), (self.missing, missing[fit])))
        order = np.lexsort((key, missing, -score))[: self.size]
        self.score, self.key, self.missing = score[order], key[order], missing[order]


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, keys: np.ndarray, missing: np.ndarray, top: Top, setting: Setting) -> None:
    """Put the best documents of a block into ``top``. A list has documents in order and what each gets."""
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: len(x[0]))
    room, short = setting.short_share * n_docs, 0
    while short < len(lists) and room >= len(lists[short][0]):
        room -= len(lists[short][0])
        short += 1
    if short > 1:
        # Term at a time: one accumulator per document of the short lists, then one list in place of them.
        docs, at = np.unique(np.concatenate([d for d, _ in lists[:short]]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, at, np.concatenate([g for _, g in lists[:short]]))
        lists[:short] = [(docs, sums)]
    lists.sort(key=lambda x: int(x[1].max()))
    bounds = np.array([int(g.max()) for _, g in lists], np.int64)
    reach = np.cumsum(bounds)  # the most that a list and all with lower bounds give together
    partial = np.zeros(setting.window, np.int64)
    seen = np.zeros(setting.window, bool)
    first = 0
    while first < n_docs:
        # Documents only on lists whose bounds together stay below the limit can't enter.
        lookup = int(np.searchsorted(reach, top.limit, "left"))
        if lookup == len(lists):
            return
        partial[:], seen[:] = 0, False
        last = min(first + setting.window, n_docs)
        for docs, gains in lists[lookup:]:
            begin, end = np.searchsorted(docs, (first, last))
            where = docs[begin:end] - first
            partial[where] += gains[begin:end]
            seen[where] = True
        found = np.flatnonzero(seen)
        score = partial[found]
        for i in range(lookup - 1, -1, -1):
            able = score + reach[i] >= top.limit
            found, score = found[able], score[able]
            docs, gains = lists[i]
            begin, end = np.searchsorted(docs, (first, last))
            if not len(found) or begin == end:
                continue
            at = begin + np.searchsorted(docs[begin:end], found + first)
            at[at == end] = end - 1
            score = score + np.where(docs[at] == found + first, gains[at], 0)
        top.add(score, keys[found + first], missing[found + first])
        first = last


def search(held: DataFrame, queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_words: int, setting: Setting) -> DataFrame:
    """(query, key, score): the best of every task's documents for each query."""
    shared = held.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        asked, w = shared.value
        tops = [Top(setting.best) for _ in asked]
        for block in blocks(batches, setting.block_rows):
            keys = block.column("key")
            missing = keys.is_null().to_numpy(zero_copy_only=False)
            keys = keys.fill_null(0).to_numpy()
            n = block.column("n").to_numpy()
            terms, starts = binary_rows(block.column("terms"), "<u4")
            times, _ = binary_rows(block.column("times"), "<u4")
            doc = np.repeat(np.arange(len(n)), np.diff(starts))
            norm = 10 + (90 * n * n_docs) // max(n_words, 1)
            tf = times.astype(np.int64)
            gain = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc]))
            order = np.argsort(terms, kind="stable")
            terms, doc, gain = terms[order], doc[order], gain[order]
            begin = np.searchsorted(terms, np.arange(len(w)), "left")
            end = np.append(begin[1:], len(terms))
            for top, (_, wanted) in zip(tops, asked):
                lists = [(doc[begin[t] : end[t]], gain[begin[t] : end[t]]) for t in wanted.tolist()]
                search_block(lists, len(n), keys, missing, top, setting)
        for top, (query, _) in zip(tops, asked):
            if len(top.score):
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array(np.full(len(top.score), query), pa.int64()),
                    "key": pa.array(top.key, pa.int64(), mask=top.missing), "score": pa.array(top.score, pa.int64()),
                })

    return held.mapInArrow(run, "query long, key long, score long")


def blocks(batches, rows: int) -> Iterator[pa.Table]:
    """Arrow batches put together to tables of about ``rows`` rows."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks()


def query_blocks(queries: DataFrame, key: str, text: str, setting: Setting) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries with their distinct terms, a bounded number of terms at a time."""
    block, n = [], 0
    for row in queries.select(col(key).cast("long"), col(text)).toLocalIterator():
        terms = sorted(set(terms_of(row[1])))
        if not terms:
            continue
        if block and n + len(terms) > setting.query_terms:
            yield block
            block, n = [], 0
        block.append((row[0], terms))
        n += len(terms)
    if block:
        yield block


def rank(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text",
    query_key: str = "item_id", query_text: str = "text", setting: Setting = Setting(),
) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's best documents with a score above 0, best first.

    Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased;
    a query counts each of its terms once. Scores are 64-bit integers: a term's weight times its saturated
    and length-normalised count, summed over the query's terms. Equal scores go by ascending key, a null key
    last. Keys are integers, and the result's columns are named after them.

    Null and empty texts have no terms: such documents are found by no query, such queries find nothing.
    Long texts count whole. Repeated documents are ranked each; repeated queries, or rows of one query key,
    are searched each and ranked among their own results. Empty tables give an empty result. Other columns
    don't take part. Queries beyond ``query_terms`` terms are searched in blocks, one pass for each.
    """
    spark, parts = docs.sparkSession, []
    for block in query_blocks(queries, query_key, query_text, setting):
        vocabulary = sorted({t for _, terms in block for t in terms})
        number = dict(zip(vocabulary, range(len(vocabulary))))
        held = postings(docs, key, text, number)
        n_docs, n_words, df = statistics(held, len(vocabulary))
        weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
        asked = [(i, np.array([number[t] for t in terms], np.int64)) for i, (_, terms) in enumerate(block)]
        found = search(held, asked, weights, n_docs, n_words, setting)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= setting.best)
        # As many names as queries, which a block bounds.
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], "query long, name long")
        parts.append(
            stored(best.join(names, "query").select("name", "rank", "key", "score"))
        )
    if not parts:
        parts.append(spark.createDataFrame([], "name long, rank int, key long, score long"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select(F.col("name").alias(query_key), "rank", F.col("key").alias(key), "score")


def ranking_sql(best: int = 10) -> str:
    """The same over the views ``documents`` and ``benchmark`` in DuckDB's SQL, by all terms of all documents."""
    pattern, upper = f"[^{SEPARATORS}]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{pattern}'))"
    return f"""
WITH words AS (SELECT doc_id, {found} AS term FROM documents),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {found} AS term FROM benchmark)),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sizes),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM counts, corpus GROUP BY term
),
gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))) AS gain
  FROM counts JOIN weights USING (term) JOIN sizes USING (doc_id), corpus
),
scores AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {best}
"""
