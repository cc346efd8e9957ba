"""How the tokens of two tokenizers line up over a corpus, with corpus-wide counts of linked id pairs.

Every text is encoded twice; byte offsets where tokens of both sides end cut them into groups, and tokens
whose bytes overlap are linked. For every pair of ids the documents that hold it linked are counted, and
each document gets sums over those counts. Counting spills: a chunk of documents writes its pair-document
records, ordered by A id and B id, as one compressed run per radix of the A id. Runs of a radix are merged
by a heap, which counts each pair; the counts, again ordered by A id, give each A id's maximum, and go over
the runs once more, which gives back what every document gets from them.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdrift.llm.frames import col, map_groups, stored, to_batch
from sparkdrift.llm.unigram import places


@dataclass(frozen=True)
class Setting:
    """``chunk_chars`` characters of text (one document at least) form a chunk, whose records are sorted in
    memory; ``radixes`` runs are written for it. A heap merges ``fan_in`` chunks' runs of a radix. A task
    that gives counts back reads about ``group_bytes`` of runs, one run at a time."""

    chunk_chars: int = 4_000_000
    radixes: int = 16
    fan_in: int = 64
    group_bytes: int = 256_000_000


#: Units whose tokens a task keeps, and their characters together, before its table starts anew.
CACHED_UNITS, CACHED_CHARS = 250_000, 8_000_000
#: Characters encoded by one call.
CALL_CHARS = 4_000
#: White space for either tokenizer, then a space: no place to cut a text.
NO_CUT = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")
_cache: dict[tuple[str, str], Units] = {}


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies spell bytes with: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pack(values: np.ndarray, dtype) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype).tobytes())


def unpack(blob, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), dtype)


class Units:
    """Both tokenizers' tokens of units of text, already aligned.

    A unit starts at a space after a character that is no white space. The A side cuts there before it
    merges, and no B piece goes on with a space, so both sides have a token end there: a text's tokens,
    groups and links are those of its units, one after another.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in piece) if set(piece) <= alphabet.keys() else piece.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            self.b_bytes.append(raw)
        if any(" " in piece.decode("utf-8", "replace").lstrip(" ") for piece in self.b_bytes):
            raise ValueError("a piece of the B side goes on with a space; units would not be independent")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # Ids as text with what follows them: inside a group, at its end, at the end of a unit.
        self.a_shown = [shown_ids(len(self.a_bytes), end) for end in ",|"]
        self.b_shown = [shown_ids(len(self.b_bytes), end) for end in ",;\n"]
        self.clear()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Units:
        if (a_path, b_path) not in _cache:
            _cache[a_path, b_path] = cls(a_path, b_path)
        return _cache[a_path, b_path]

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.shown: list[str] = []  # groups as text
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, whether both sides spell the unit
        self.pairs = np.zeros(0, np.uint64)  # links, A id above, B id below
        self.starts = np.zeros(1, np.int64)

    def coded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, B ids, whether both sides spell each unit) of units one after another.

        Units are encoded many to a call: put together they are cut in the same places again. If a side does
        not spell the bytes, its units are looked at one by one, and those that it does not spell have no ids.
        """
        joined = "".join(units)
        a = self.a.encode(joined, add_special_tokens=False).ids
        b = self.b.encode(joined[1:])
        raw = joined.encode()
        if b"".join([self.a_bytes[x] for x in a]) == raw and b"".join([self.b_bytes[x] for x in b]) == raw:
            return np.array(a, np.int64), np.array(b, np.int64), np.ones(len(units), bool)
        if len(units) == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, bool)
        parts = [self.coded([u]) for u in units]
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))

    def aligned(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(groups as text, counts, links, number of links) of units."""
        parts = [self.coded(call) for call in calls(units)]
        a, b, spelt = (np.concatenate([p[k] for p in parts]) for k in range(3))
        sizes = np.fromiter((len(u.encode()) for u in units), np.int64, len(units)) * spelt
        unit_end = np.cumsum(sizes)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # Links: the B tokens that start before an A token ends and end after it starts.
        first = np.searchsorted(b_end, a_end - self.a_size[a], "right")
        links = np.searchsorted(b_end - self.b_size[b], a_end, "left") - first
        pairs = (np.repeat(a, links).astype(np.uint64) << np.uint64(32)) | b[places(first, links)].astype(np.uint64)
        unit_a, unit_b = np.searchsorted(unit_end, a_end), np.searchsorted(unit_end, b_end)
        n_links = np.bincount(unit_a, links, len(units)).astype(np.int64)
        a_cuts, b_cuts = np.isin(a_end, b_end), np.isin(b_end, a_end)
        n_groups = np.bincount(unit_a[a_cuts], minlength=len(units))
        n_a, n_b = (np.bincount(unit, minlength=len(units)) for unit in (unit_a, unit_b))
        shown = iter(self.grouped_text(a, a_cuts, b, b_cuts, np.isin(b_end, unit_end)))
        return [next(shown) if ok else "" for ok in spelt], np.stack([n_a, n_b, n_groups, spelt], axis=1), pairs, n_links

    def grouped_text(self, a: np.ndarray, a_cuts: np.ndarray, b: np.ndarray, b_cuts: np.ndarray, last: np.ndarray) -> list[str]:
        """Per unit its groups as ``a1,a2|b1;a3|b2``; a token belongs to the group of the next common end."""
        group_a, group_b = np.cumsum(a_cuts) - a_cuts, np.cumsum(b_cuts) - b_cuts
        out = np.empty(len(a) + len(b), object)
        # A's tokens come after B's of earlier groups, B's after A's of the same and earlier groups.
        out[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = np.where(a_cuts, self.a_shown[1][a], self.a_shown[0][a])
        ends = np.where(last, self.b_shown[2][b], np.where(b_cuts, self.b_shown[1][b], self.b_shown[0][b]))
        out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = ends
        return "".join(out.tolist()).split("\n")[:-1]

    def learn(self, units: list[str]) -> None:
        shown, counts, pairs, n_links = self.aligned(units)
        self.number.update(zip(units, range(len(self.shown), len(self.shown) + len(units))))
        self.chars += sum(map(len, units))
        self.shown += shown
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])

    def documents(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
        """(counts, groups as text, links) of each text; nothing where a side doesn't spell it."""
        if len(self.number) > CACHED_UNITS or self.chars > CACHED_CHARS:
            self.clear()
        rows = [units_of(text) for text in texts]
        fresh = set().union(*rows) - self.number.keys()
        if fresh:
            self.learn(list(fresh))
        nothing = np.zeros(3, np.int64), b"", np.zeros(0, np.uint64)
        for row in rows:
            if not row:
                yield nothing
                continue
            numbers = list(map(self.number.__getitem__, row))
            at = np.array(numbers, np.int64)
            counts = self.counts[at].sum(axis=0)
            if counts[3] < len(row):
                yield nothing
                continue
            shown = self.shown
            pairs = self.pairs[places(self.starts[at], self.starts[at + 1] - self.starts[at])]
            yield counts[:3], ";".join([shown[i] for i in numbers]).encode(), pairs


def shown_ids(size: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(size)], object)


def calls(units: list[str]) -> Iterator[list[str]]:
    """Units to encode together; one that ends with white space is last in its call."""
    call, size = [], 0
    for unit in units:
        call.append(unit)
        size += len(unit)
        if size > CALL_CHARS or unit[-1].isspace():
            yield call
            call, size = [], 0
    if call:
        yield call


def units_of(text: str | None) -> list[str]:
    """The units of a space and the text; an empty text has none."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and not NO_CUT.search(text):
        return [" " + word for word in text.split(" ")]
    units = CUT.split(" " + text)
    if len(units) > 1 and not units[-1].strip(" "):
        # Spaces alone at the end belong to the unit before: by themselves they would lose the first one.
        units[-2:] = [units[-2] + units[-1]]
    return units


def encoded(docs: DataFrame, key: str, text: str, a_path: str, b_path: str, setting: Setting) -> DataFrame:
    """Document rows, and the runs of each chunk: rows with a radix.

    A run has its distinct pairs in order, the number of documents of each, and the records: the documents'
    places in the chunk, pair by pair, with how often each holds the pair linked.
    """
    doc_key = docs.schema[key].dataType.simpleString()
    schema = (
        f"chunk long, radix int, place int, `key` {doc_key}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, pairs binary, holders binary, records binary, times binary, n_bytes long"
    )

    def run(batches):
        units = Units.of(a_path, b_path)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
            part = np.cumsum(sizes) // setting.chunk_chars
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1) if texts else []:
                yield from chunk_rows(units, [texts[i] for i in rows], batch.column(0).slice(rows[0], len(rows)), chunk, setting)
                chunk += 1

    return stored(docs.select(col(key).alias("key"), col(text).alias("text")).mapInArrow(run, schema))


def chunk_rows(units: Units, texts: list[str | None], keys: pa.Array, chunk: int, setting: Setting) -> Iterator[pa.RecordBatch]:
    n = len(texts)
    counts, shown, held, sizes = np.zeros((n, 3), np.int64), [""] * n, [], np.zeros(n, np.int64)
    for i, (numbers, groups, links) in enumerate(units.documents(texts)):
        counts[i], sizes[i] = numbers, len(links)
        if numbers[0]:
            shown[i] = hashlib.sha256(groups).hexdigest()
        pairs, times = np.unique(links, return_counts=True)
        held.append((pairs, times.astype(np.uint32)))
    empty = pa.nulls(n, pa.binary())
    yield pa.RecordBatch.from_pydict({
        "chunk": pa.array(np.full(n, chunk)), "radix": pa.nulls(n, pa.int32()), "place": pa.array(np.arange(n, dtype=np.int32)),
        "key": keys, "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": sizes,
        "groups_sha256": shown, "pairs": empty, "holders": empty, "records": empty, "times": empty,
        "n_bytes": pa.nulls(n, pa.int64()),
    })
    pairs = np.concatenate([p for p, _ in held])
    place = np.repeat(np.arange(n, dtype=np.uint32), [len(p) for p, _ in held])
    times = np.concatenate([t for _, t in held])
    order = np.argsort(pairs, kind="stable")  # documents stay in order within a pair
    pairs, place, times = pairs[order], place[order], times[order]
    radix = (pairs >> np.uint64(32)) % np.uint64(setting.radixes)
    blobs = []
    for r in range(setting.radixes):
        mine = radix == r
        if not mine.any():
            continue
        distinct, holders = np.unique(pairs[mine], return_counts=True)
        blobs.append((r, pack(distinct, np.uint64), pack(holders, np.uint32), pack(place[mine], np.uint32), pack(times[mine], np.uint32)))
    k, none = len(blobs), pa.nulls(len(blobs), pa.int64())
    yield pa.RecordBatch.from_pydict({
        "chunk": pa.array(np.full(k, chunk, np.int64)), "radix": pa.array([x[0] for x in blobs], pa.int32()),
        "place": pa.nulls(k, pa.int32()), "key": pa.nulls(k, keys.type), "n_a": none, "n_b": none, "n_groups": none,
        "n_links": none, "groups_sha256": pa.nulls(k, pa.string()),
        **{name: pa.array([x[i] for x in blobs], pa.binary()) for i, name in enumerate(("pairs", "holders", "records", "times"), 1)},
        "n_bytes": pa.array([sum(map(len, x[1:])) for x in blobs], pa.int64()),
    })


MERGED = pa.schema([("radix", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
COUNTED = pa.schema([("radix", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def merge_runs(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each pair's documents over the runs of a (radix, group), merged by a heap."""
    ends = np.append(starts[1:], rows.num_rows)
    for begin, end in zip(starts.tolist(), ends.tolist()):
        runs = rows.slice(begin, end - begin)
        streams = [
            zip(unpack(p.as_py(), np.uint64).tolist(), unpack(h.as_py(), np.uint32).tolist())
            for p, h in zip(runs.column("pairs"), runs.column("holders"))
        ]
        pairs, counts = [], []
        for pair, hits in groupby(heapq.merge(*streams), itemgetter(0)):
            pairs.append(pair)
            counts.append(sum(n for _, n in hits))
        keys = np.array(pairs, np.uint64)
        radix = np.full(len(keys), runs.column("radix")[0].as_py(), np.int32)
        yield to_batch(MERGED, radix, (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(2**32 - 1)).astype(np.int64), counts)


def mark_best(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted pairs of whole A ids in B order, with those whose count is their A id's highest marked.

    ``starts`` are those of (radix, a) groups; a group has at most as many rows as the B side has ids.
    """
    radix, n = rows.column("radix").to_numpy(), rows.column("n").to_numpy()
    highest = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n))))
    pairs = (rows.column("a").to_numpy().astype(np.uint64) << np.uint64(32)) | rows.column("b").to_numpy().astype(np.uint64)
    cuts = np.flatnonzero(np.diff(radix)) + 1
    for mine in np.split(np.arange(len(n)), cuts):
        yield to_batch(
            COUNTED,
            [int(radix[mine[0]])],
            [pack(pairs[mine], np.uint64)],
            [pack(n[mine], np.int64)],
            [pack(n[mine] == highest[mine], np.uint8)],
        )


BACK = pa.schema([("chunk", pa.int64()), ("n_best", pa.binary()), ("count_sum", pa.binary())])


def give_back(batches) -> Iterator[pa.RecordBatch]:
    """Counts of a (radix, group) first, then its runs one by one: what each run's documents get."""
    at, counted, table = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if at != (row["radix"], row["group"]):
                at, counted, table = (row["radix"], row["group"]), [], None
            if row["counts"] is not None:
                counted.append((unpack(row["pairs"], np.uint64), unpack(row["counts"], np.int64), unpack(row["best"], np.uint8)))
                continue
            if table is None:
                table = [np.concatenate(c) for c in zip(*counted)]
                order = np.argsort(table[0])
                table, counted = [c[order] for c in table], []
            where = np.searchsorted(table[0], unpack(row["pairs"], np.uint64))
            where = np.repeat(where, unpack(row["holders"], np.uint32))
            place, times = unpack(row["records"], np.uint32), unpack(row["times"], np.uint32).astype(np.int64)
            n_best, sums = (np.zeros(int(place.max()) + 1, np.int64) for _ in range(2))
            np.add.at(n_best, place, times * table[2][where])
            np.add.at(sums, place, times * table[1][where])
            yield to_batch(BACK, [row["chunk"]], [pack(n_best, np.int64)], [pack(sums, np.int64)])


def align(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", setting: Setting = Setting()
) -> DataFrame:
    """One row per row of ``docs``: the key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds the space. ``n_links`` are the pairs of an
    A and a B token whose bytes overlap. A pair of ids counts the rows of ``docs`` that hold it linked;
    ``n_best`` are the links whose count is the highest of their A id, ties included, ``count_sum`` sums the
    counts over the links. The hash is that of the groups as ``a1,a2|b1;a3|b2,b3``.

    Texts that are null, empty or not spelt by both sides' tokens have zeros and an empty string instead of
    a hash, and count for no pair. Long texts are encoded whole. Repeated rows and rows of one key each
    count for themselves. An empty table gives an empty one. Only the key and the new columns are returned.
    """
    rows = encoded(docs, key, text, a_path, b_path, setting)
    runs = rows.where("radix IS NOT NULL")
    size = runs.agg(F.count_distinct("chunk").alias("chunks"), F.sum("n_bytes").alias("bytes")).first()
    # Groups of chunks: a number of the table's size, so that no task reads more than a bounded part of it.
    merges = 1 + size["chunks"] // setting.fan_in
    groups = 1 + (size["bytes"] or 0) // setting.radixes // setting.group_bytes

    def group(number: int):
        return F.pmod(F.xxhash64("chunk"), F.lit(number)).cast("int").alias("group")

    merged = map_groups(
        runs.select("radix", group(merges), "pairs", "holders"),
        ["radix", "group"], merge_runs, "radix int, a long, b long, n long",
    )
    summed = merged.groupBy("radix", "a", "b").agg(F.sum("n").alias("n"))
    counted = stored(map_groups(summed, ["radix", "a"], mark_best, "radix int, pairs binary, counts binary, best binary", ["b"]))
    every = counted.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = every.unionByName(runs.select("radix", group(groups), "chunk", "pairs", "holders", "records", "times"), True)
    # Null counts sort last: a group's counts come before its runs.
    given = (
        both.repartition("radix", "group")
        .sortWithinPartitions("radix", "group", F.col("counts").isNull())
        .mapInArrow(give_back, "chunk long, n_best binary, count_sum binary")
    )
    found = rows.where("radix IS NULL").select(
        "chunk", "place", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"
    )
    return with_sums(found, given, key)


def with_sums(found: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Document rows with the sums that the runs of their chunk gave back."""
    names = ["n_a", "n_b", "n_groups", "n_links"]
    key_type = found.schema["key"].dataType.simpleString()
    schema = f"`key` {key_type}, " + ", ".join(f"{c} long" for c in [*names, "n_best", "count_sum"]) + ", groups_sha256 string"

    def run(batches):
        chunk, totals = None, {}
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            for rows in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(chunks)) + 1) if len(chunks) else []:
                part = batch.slice(rows[0], len(rows))
                if chunk != chunks[rows[0]]:
                    chunk, totals = chunks[rows[0]], {}
                sums = part.column("sums_of_best")
                n_sums = len(sums) - sums.null_count
                for row in part.slice(0, n_sums).select(["sums_of_best", "sums_of_count"]).to_pylist():
                    for name, blob in zip(("n_best", "count_sum"), row.values()):
                        add = unpack(blob, np.int64)
                        old = totals.get(name, add[:0])
                        totals[name] = np.zeros(max(len(old), len(add)), np.int64)
                        totals[name][: len(old)] += old
                        totals[name][: len(add)] += add
                part = part.slice(n_sums)
                if part.num_rows:
                    place = part.column("place").to_numpy()
                    picked = {c: part.column(c) for c in ("key", *names)}
                    for name in ("n_best", "count_sum"):
                        held = totals.get(name, np.zeros(0, np.int64))
                        picked[name] = pa.array(np.append(held, np.zeros(int(place.max()) + 1, np.int64))[place])
                    yield pa.RecordBatch.from_pydict(picked | {"groups_sha256": part.column("groups_sha256")})

    sums = given.select("chunk", F.col("n_best").alias("sums_of_best"), F.col("count_sum").alias("sums_of_count"))
    both = sums.unionByName(found, True)
    done = both.repartition("chunk").sortWithinPartitions("chunk", F.col("sums_of_best").isNull()).mapInArrow(run, schema)
    order = ["key", *names, "n_best", "count_sum", "groups_sha256"]
    return done.select(*order).withColumnRenamed("key", key)
