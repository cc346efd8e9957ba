"""Best-fit packing of tokenised documents into sequences with several capacities.

A sequence has room for tokens, for documents and for attention cost (the sum of squared piece lengths).
Pieces are dealt by a hash to groups of bounded size, and each group is packed by itself in decreasing
length: a piece goes to the open sequence that fits under every capacity and scores best.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdrift.llm.frames import col, stored, to_batch, whole_groups
from sparkdrift.llm.unigram import places


@dataclass(frozen=True)
class Setting:
    """Capacities of a sequence and how sequences are selected.

    ``choice`` is "norm" (least weighted norm of what is left after placing, the best fit) or "dot" (largest
    weighted product of the piece's demands and what is left before). The defaults of ``documents`` and
    ``attention`` can't bind before the tokens do, so the number of sequences stays as low as tokens allow;
    lower ones are honoured. ``group_rows`` is the size of the groups that are packed by themselves; each
    leaves about one sequence partly filled.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    choice: str = "norm"
    group_rows: int = 4096
    end_id: int = 0


#: White space for Python but not for the tokenizer, and the start of a special token.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
CACHED_WORDS = 600_000
_cache: dict[str, WordTokens] = {}


class Numbers(dict):
    """Numbers of words; a word that is new gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.noted: list[str] = []

    def __missing__(self, word: str) -> int:
        self.noted.append(word)
        self[word] = number = len(self)
        return number


class WordTokens:
    """Token ids of texts, word by word, for a tokenizer that never joins letters across white space.

    Ids of words seen before come from a table, which starts anew beyond CACHED_WORDS. Texts in which words
    can't be told apart that simply are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in _cache:
            _cache[path] = cls(path)
        return _cache[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self) -> None:
        """Encode the noted words, many to a call: one text of words with the ends of each found by offsets."""
        words, self.number.noted = self.number.noted, []
        ids, lengths = [], []
        joined = [" ".join(words[at : at + 512]) for at in range(0, len(words), 512)]
        for text, coded in zip(joined, self.tokenizer.encode_batch(joined, add_special_tokens=False)):
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            word_at = np.cumsum(points == 32)
            spans = np.array(coded.offsets, np.int64).reshape(-1, 2)
            lengths.append(np.bincount(word_at[spans[:, 0]], minlength=int(word_at[-1]) + 1))
            ids.append(np.array(coded.ids, np.uint32))
        self.flat = np.concatenate([self.flat, *ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > CACHED_WORDS:
            self.clear()
        rows = []
        for text in texts:
            text = text or ""
            if latin(text) and not any(x in text for x in ODD):
                words = text.lower().split()
                rows.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            else:
                rows.append(text)
        if self.number.noted:
            self.learn()
        return [
            self.whole(row)
            if isinstance(row, str)
            else self.flat[places(self.starts[row], self.starts[row + 1] - self.starts[row])]
            for row in rows
        ]


def latin(text: str) -> bool:
    """Whether lower-casing and the tokenizer's normal form can change places: no letters beyond Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


PIECES = pa.schema(
    [("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    + [("ids_crc32", pa.int64()), ("ids", pa.list_(pa.uint32()))]
)


def pieces(docs: DataFrame, tokenizer: str, key: str, text: str, setting: Setting, with_ids: bool) -> DataFrame:
    """(doc, piece, start, length, ids_crc32) and, if asked for, ids: documents cut at the token capacity.

    A document's ids are those of its text and one ``end_id``; a null text counts as empty.
    """
    room = setting.tokens
    fields = list(PIECES)[: 6 if with_ids else 5]
    fields = [f if f.name != "ids" else pa.field("ids", pa.list_(pa.int64())) for f in fields]
    schema = pa.schema(fields)

    def run(batches):
        words = WordTokens.of(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(setting.end_id)).astype("<u4")
                    for number, start in enumerate(range(0, len(ids), room)):
                        cut = ids[start : start + room]
                        row = (doc, number, start, len(cut), zlib.crc32(cut.tobytes()))
                        rows.append((*row, cut.astype(np.int64)) if with_ids else row)
                yield to_batch(schema, *zip(*rows))

    ddl = "doc long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(col(key).cast("long"), col(text).cast("string")).mapInArrow(run, ddl)


def fill(lengths: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, pieces being taken in the order given.

    Open sequences are rows of residual capacities. Those that can't take a piece under every capacity are
    no candidates; the best of the others takes it, and ties go to the oldest. Full ones are closed.
    """
    n = len(lengths)
    whole = np.array([setting.tokens, setting.documents, setting.attention], np.float64)
    weights = np.array(setting.weights)
    left = np.empty((max(16, n), 3))
    number = np.empty(max(16, n), np.int64)
    used = np.zeros(n, np.int64)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    opened = count = 0
    for i, length in enumerate(lengths):
        demand = np.array([length, 1, float(length) ** 2])
        if (demand > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of an empty sequence")
        fits = np.flatnonzero((left[:count] >= demand).all(1))
        if len(fits):
            if setting.choice == "dot":
                score = -((left[fits] / whole) @ (weights * demand / whole))
            else:
                score = (((left[fits] - demand) / whole) ** 2) @ weights
            slot = fits[np.argmin(score)]
        else:
            slot, count = count, count + 1
            left[slot], number[slot] = whole, opened
            opened += 1
        bins[i] = number[slot]
        offsets[i] = used[number[slot]]
        used[number[slot]] += length
        left[slot] -= demand
        if left[slot, 0] < 1 or left[slot, 1] < 1 or left[slot, 2] < 1:
            left[slot : count - 1] = left[slot + 1 : count]
            number[slot : count - 1] = number[slot + 1 : count]
            count -= 1
    return bins, offsets


def pack(cut: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``cut`` pieces (doc, piece, start, length, ids_crc32) with sequence_id and offset.

    Groups hold about ``group_rows`` pieces of any documents, so no task grows with the input and no hot
    document or source matters. Each group is packed on its own from its rows' values, so a lost task gives
    the same sequences again. Rows that repeat a document are packed as often as they come. Sequence ids are
    unique but not dense.
    """
    cut = stored(cut)
    groups = max(1, -(-cut.count() // setting.group_rows))
    row = [F.col(c) for c in ("doc", "piece", "start", "length", "ids_crc32")]
    dealt = cut.withColumn("group_no", F.pmod(F.xxhash64("doc", "piece"), F.lit(groups)))
    schema = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def each(batches):
        for rows, starts in whole_groups(batches, ["group_no"]):
            ends = np.append(starts[1:], rows.num_rows)
            length, group = rows.column("length").to_numpy(), rows.column("group_no").to_numpy()
            bins, offsets = np.empty(rows.num_rows, np.int64), np.empty(rows.num_rows, np.int64)
            for s, e in zip(starts, ends):
                bins[s:e], offsets[s:e] = fill(length[s:e], setting)
                bins[s:e] += group[s] << 32
            shown = rows.select([f.name for f in schema][:5]).cast(pa.schema(list(schema)[:5]))
            shown = shown.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))
            yield from shown.to_batches()

    ordered = dealt.select("group_no", *row).repartitionByRange("group_no")
    ordered = ordered.sortWithinPartitions("group_no", F.desc("length"), "doc", "piece", "ids_crc32")
    ddl = "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ordered.mapInArrow(each, ddl)


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", setting: Setting = Setting()
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for all pieces of all documents.

    Only documents longer than a sequence are cut. ids_crc32 is the CRC of the ids as little-endian unsigned
    32-bit integers. An empty table gives no pieces; null keys are packed like others.
    """
    packed = pack(pieces(docs, tokenizer, key, text, setting, with_ids=False), setting)
    return packed.withColumnRenamed("doc", key)
