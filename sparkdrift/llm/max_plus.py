"""SentencePiece encoding and decoding, giant documents by a max-plus scan over chunks.

Text is segmented by the best sum of piece scores. A document longer than a chunk is split, and chunks are
rows that any task can take. The state at a chunk boundary is the number of characters by which the piece
across it reaches into the next chunk. A chunk yields a matrix of best scores from each state at its start
to each state at its end; matrices combine associatively under (max, +). From the states that the scan
selects, each chunk is traced back on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sparkdrift.llm.frames import col, free_name, map_groups, stored, to_batch
from sparkdrift.llm.unigram import (
    PRE_TOKEN,
    Segments,
    Vocabulary,
    normal,
    numbered,
    places,
    plain,
    text_chunks,
    vocabulary,
)

LOW = -1e300
#: Characters encoded at a time. Encoding and decoding run side by side, so there are two workers a task.
ENCODED_CHARACTERS = 1_000_000


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def cuts(form: str, size: int, states: int) -> tuple[int, int] | None:
    """First and last place of a chunk that no piece crosses, past all states of its start, or None."""
    found = [m.start() for m in PRE_TOKEN.finditer(form) if states - 1 <= m.start() <= size]
    # A pre-token that starts after a space run, or at a line break, can't be reached by a piece from before.
    found = [x for x in found if x > 0]
    return (found[0], found[-1]) if found else None


def ends_from(v: Vocabulary, form: str, start: int, size: int, states: int) -> tuple[list[int], np.ndarray]:
    """Back pieces and, for each state, the best score of form[start : size + state].

    A piece that reaches over the boundary starts before it, and so does whatever comes before.
    """
    last, score = v._forward(form[start : size + states - 1])
    out = np.full(states, LOW)
    n = len(last) - 1
    for state in range(states):
        end = size + state - start
        if end > n or end < 0:
            continue
        if state == 0:
            out[0] = score[end]
            continue
        for piece in range(state + 1, min(v.longest, end) + 1):
            i = v.id_of.get(form[start + end - piece : start + end])
            if i is not None:
                out[state] = max(out[state], score[end - piece] + v.score_of[i])
    return last, out


def crossing(v: Vocabulary, form: str, start: int, size: int, state: int) -> list[int]:
    """Ids of the best segmentation of form[start : size + state] whose last piece crosses the boundary."""
    last, score = v._forward(form[start : size + state])
    end = size + state - start
    if state == 0:
        return v._trace(form[start : size], last, end)
    best, found = LOW, None
    for piece in range(state + 1, min(v.longest, end) + 1):
        i = v.id_of.get(form[start + end - piece : start + end])
        if i is not None and score[end - piece] + v.score_of[i] > best:
            best, found = score[end - piece] + v.score_of[i], (end - piece, i)
    return [*v._trace(form[start:], last, found[0]), found[1]]


def transfer(v: Vocabulary, form: str, size: int) -> np.ndarray:
    """Scores from each state at a chunk's start to each state at its end.

    Between the first and the last cut the best segmentation is the same for all states, so its score is
    left out: a constant added to a whole matrix changes no choice.
    """
    states = v.longest
    out = np.full((states, states), LOW)
    edge = cuts(form, size, states)
    if edge is None:
        for state in range(min(states, size + 1)):
            out[state] = ends_from(v, form, state, size, states)[1]
        return out
    first, last = edge
    _, tail = ends_from(v, form, last, size, states)
    for state in range(states):
        out[state] = v._forward(form[state:first])[1][-1] + tail
    return out


def trace(v: Vocabulary, form: str, size: int, enter: int, leave: int) -> list[np.ndarray]:
    """Ids of a chunk between the two states that the scan selected, in parts."""
    edge = cuts(form, size, v.longest)
    if edge is None:
        return [np.array(crossing(v, form, enter, size, leave), np.int32)]
    first, last = edge
    words = PRE_TOKEN.findall(form[first:last])
    distinct = list(dict.fromkeys(words))
    held = Segments(distinct, v, with_ids=True)
    number = {w: i for i, w in enumerate(distinct)}
    middle = [held.flat[held.starts[number[w]] : held.starts[number[w] + 1]] for w in words]
    head = np.array(v.best_path(form[enter:first])[0], np.int32)
    return [head, *middle, np.array(crossing(v, form, last, size, leave), np.int32)]


def _encode_whole(docs: DataFrame, model: str, text: str, name: str, offset: float) -> DataFrame:
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))])
    place = docs.columns.index(text)

    def run(batches):
        v = vocabulary(model, offset)
        for batch in batches:
            for start, texts in text_chunks(batch.column(place), ENCODED_CHARACTERS):
                distinct, rows = numbered([normal(x) for x in texts])
                held = Segments(distinct, v, with_ids=True)
                every = np.concatenate(rows) if rows else np.empty(0, np.int64)
                flat = held.flat[places(held.starts[every], held.counts[every])]
                ends = np.cumsum([int(held.counts[r].sum()) for r in rows])
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def _encode_giants(giants: DataFrame, model: str, chunk: int, offset: float) -> DataFrame:
    """(key, tag, ids) of distinct long texts (key, tag, text)."""
    cut_schema = pa.schema(
        [("key", pa.int64()), ("tag", pa.int64()), ("number", pa.int32()), ("size", pa.int32())]
        + [("form", pa.string()), ("matrix", pa.binary())]
    )

    def split(batches):
        v = vocabulary(model, offset)
        for batch in batches:
            for key, tag, text in zip(*(c.to_pylist() for c in batch.columns)):
                form = normal(text)
                for number, at in enumerate(range(0, len(form), chunk)):
                    size = min(chunk, len(form) - at)
                    part = form[at : at + chunk + v.longest - 1]
                    yield to_batch(cut_schema, [key], [tag], [number], [size], [part], [None])

    def matrices(batches):
        v = vocabulary(model, offset)
        for batch in batches:
            forms, sizes = batch.column(4).to_pylist(), batch.column(3).to_pylist()
            found = [transfer(v, form, size).tobytes() for form, size in zip(forms, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.binary())], schema=cut_schema)

    ddl = "key long, tag long, number int, size int, form string, matrix binary"
    chunks = giants.select("key", "tag", "text").mapInArrow(split, ddl)
    chunks = stored(chunks.repartition("key", "tag", "number").mapInArrow(matrices, ddl))
    states = pa.schema([(n, t) for n, t in zip(cut_schema.names[:3], cut_schema.types[:3])])
    states = states.append(pa.field("enter", pa.int32())).append(pa.field("leave", pa.int32()))

    def scan(table, starts):
        for s, e in zip(starts, np.append(starts[1:], table.num_rows)):
            rows = [np.frombuffer(x.as_py(), np.float64) for x in table.column("matrix")[s:e]]
            side = int(len(rows[0]) ** 0.5)
            reach = np.full(side, LOW)
            reach[0] = 0.0
            before = []
            for row in rows:  # prefixes of the product, applied to the only state a text starts in
                before.append(reach)
                reach = np.maximum(combined(reach[None, :], row.reshape(side, side))[0], LOW)
                reach = np.where(reach > LOW / 2, reach - reach.max(), LOW)
            leave, enter = np.zeros(e - s, np.int32), np.zeros(e - s, np.int32)
            state = 0
            for at in range(len(rows) - 1, -1, -1):
                leave[at] = state
                state = int(np.argmax(before[at] + rows[at].reshape(side, side)[:, state]))
                enter[at] = state
            keys = [table.column(c).to_numpy()[s:e] for c in ("key", "tag", "number")]
            yield to_batch(states, *keys, enter, leave)

    scanned = map_groups(
        chunks.select("key", "tag", "number", "matrix"),
        ["key", "tag"],
        scan,
        "key long, tag long, number int, enter int, leave int",
        ["number"],
    )

    def traced(batches):
        v = vocabulary(model, offset)
        for batch in batches:
            key, tag, number, size, form, enter, leave = (c.to_pylist() for c in batch.columns)
            ids = [np.concatenate(trace(v, *x)).tolist() for x in zip(form, size, enter, leave)]
            arrays = [*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "tag", "number", "ids"])

    names = ["key", "tag", "number"]
    own = chunks.drop("matrix").join(stored(scanned), names)
    parts = own.select(*names, "size", "form", "enter", "leave").mapInArrow(
        traced, "key long, tag long, number int, ids array<int>"
    )
    listed = parts.groupBy("key", "tag").agg(F.array_sort(F.collect_list(F.struct("number", "ids"))).alias("parts"))
    return listed.select("key", "tag", F.flatten("parts.ids").alias("ids"))


def encode(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", chunk: int = 65_536, offset: float = 1000.0
) -> DataFrame:
    """``docs`` with ``ids``, the encoding of each whole text.

    Texts of more than ``chunk`` characters go the way of chunks and scan, with the same result. Null and
    empty texts have no ids. Repeated rows get the same ids. A column called ids makes the new one ids_.
    """
    name = free_name(docs, "ids")
    long = F.coalesce(F.length(col(text)) > chunk, F.lit(False))
    whole = _encode_whole(docs.where(~long), model, text, name, offset)
    tag = F.xxhash64(col(text), F.coalesce(col(key).cast("long"), F.lit(-1)))
    k, t = free_name(docs, "key_of"), free_name(docs, "tag_of")
    giants = docs.where(long).withColumns({k: F.coalesce(col(key).cast("long"), F.lit(-1)), t: tag})
    distinct = giants.select(col(k).alias("key"), col(t).alias("tag"), col(text).cast("string").alias("text"))
    found = _encode_giants(distinct.dropDuplicates(["key", "tag"]), model, chunk, offset)
    found = stored(found.select(F.col("key").alias(k), F.col("tag").alias(t), F.col("ids").alias(name)))
    long_rows = giants.join(found, [k, t], "left").select(*[col(c) for c in docs.columns], col(name))
    return whole.unionByName(long_rows)


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids spell; null ids stay null."""
    name = free_name(encoded, name)
    schema = StructType([*encoded.schema.fields, StructField(name, StringType())])
    place = encoded.columns.index(ids)

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                spelt = [plain(v.decode(x.values.to_numpy())) if x.is_valid else None for x in part.column(place)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(spelt, pa.string())], names=[*part.schema.names, name]
                )

    return encoded.mapInArrow(run, schema)
