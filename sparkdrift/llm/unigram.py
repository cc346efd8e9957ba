"""A unigram vocabulary, and best segmentations of many pre-tokens at once over a shared trie.

Pieces come from a SentencePiece model file. That file orders its pieces but holds no probabilities, so a
piece has the score -log(rank + offset): a Zipf-Mandelbrot law over the order, with the offset a parameter.
A character without a piece becomes its UTF-8 bytes, at ten below the lowest score.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

SPACE = "▁"
#: White space that no piece holds is cut off, so lines are separate pre-tokens.
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
LONG = 64


class Vocabulary:
    """Pieces, their scores, and a trie over the reversed pieces with its edges in one sorted array."""

    def __init__(self, path: str, offset: float = 1000.0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [
            i
            for i in range(len(self.pieces))
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.shown = list(self.pieces)  # with the bytes that are letters by themselves spelt out
        for byte in range(128):
            self.shown[self.byte_id[byte]] = chr(byte)
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score_of = {i: -float(np.log(rank + offset)) for rank, i in enumerate(plain)}
        self.unknown = min(self.score_of.values()) - 10.0
        self.longest = max(map(len, self.id_of))
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id_of):
            raise ValueError("a piece crosses the start of a word")
        alphabet = sorted({c for p in self.id_of for c in p})
        self.letter_of = np.zeros(0x110000, np.int32)
        self.letter_of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.letters = len(alphabet) + 1
        self._reversed_trie()

    def _reversed_trie(self) -> None:
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        for piece, i in self.id_of.items():
            state = 0
            for c in reversed(piece):
                state = edges.setdefault(state * self.letters + int(self.letter_of[ord(c)]), len(edges) + 1)
            ends[state] = i
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edge_key, self.edge_to = keys[order], np.array(list(edges.values()), np.int32)[order]
        self.end_id = np.full(len(edges) + 1, -1, np.int32)
        self.end_id[list(ends)] = list(ends.values())
        self.end_score = np.full(len(edges) + 1, -np.inf)
        self.end_score[list(ends)] = [self.score_of[i] for i in ends.values()]
        self.first = np.zeros(self.letters, np.int32)
        root = self.edge_key < self.letters
        self.first[self.edge_key[root]] = self.edge_to[root]

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next state of each walk, 0 where it ends."""
        key = state.astype(np.int64) * self.letters + letter
        at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
        return np.where(self.edge_key[at] == key, self.edge_to[at], 0)

    def best_path(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of one string, character by character."""
        ids, score = self._forward(text)
        return self._trace(text, ids, len(text)), score[len(text)]

    def _forward(self, text: str, start: int = 0) -> tuple[list[int], list[float]]:
        n = len(text)
        low = float("-inf")
        score, last = [low] * (n + 1), [-1] * (n + 1)
        score[start] = 0.0
        for end in range(start + 1, n + 1):
            c = text[end - 1]
            best, piece = score[end - 1] + self.unknown, -1
            if c in self.id_of:
                best = low
            for size in range(1, min(self.longest, end - start) + 1):
                i = self.id_of.get(text[end - size : end])
                if i is not None and score[end - size] + self.score_of[i] > best:
                    best, piece = score[end - size] + self.score_of[i], i
            score[end], last[end] = best, piece
        return last, score

    def _trace(self, text: str, last: list[int], end: int, start: int = 0) -> list[int]:
        out: list[int] = []
        while end > start:
            if last[end] < 0:
                out += [int(self.byte_id[b]) for b in reversed(text[end - 1].encode("utf-8", "surrogatepass"))]
                end -= 1
            else:
                out.append(last[end])
                end -= len(self.pieces[last[end]])
        return out[::-1]

    def decode(self, ids: np.ndarray) -> str:
        """The normal form that these ids spell."""
        high = (ids >= self.byte_id[128]) & (ids <= self.byte_id[255])
        if not high.any():
            return "".join(map(self.shown.__getitem__, ids.tolist()))
        out, raw = [], bytearray()
        first_byte, last_byte = int(self.byte_id[0]), int(self.byte_id[255])
        for i in ids.tolist():
            if first_byte <= i <= last_byte:
                raw.append(i - first_byte)
                continue
            out += [raw.decode("utf-8", "replace"), self.pieces[i]]
            raw = bytearray()
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str, offset: float = 1000.0) -> Vocabulary:
    return Vocabulary(path, offset)


def normal(text: str | None) -> str:
    """Spaces as their visible mark, one more in front; nothing for an empty text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def plain(form: str) -> str:
    return form[1:].replace(SPACE, " ")


class Segments:
    """The best segmentations of distinct pre-tokens: number of ids of each, and ids if asked for.

    Sorted pre-tokens form a trie. Forward scores are computed once per trie node, one depth at a time for
    all nodes of that depth; where a pre-token ends, its node has its count of ids. Of equal scores the one
    with the shorter last piece wins. Pre-tokens over LONG characters are segmented one by one.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary, with_ids: bool):
        self.counts = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        short.sort(key=words.__getitem__)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of pre-tokens, and their ids one after another
        self.nodes = 0
        for at in range(0, len(short), 50_000):
            self._run(short[at : at + 50_000], words, vocabulary, held if with_ids else None)
        for i, w in enumerate(words):
            if len(w) > LONG:
                ids, _ = vocabulary.best_path(w)
                self.counts[i] = len(ids)
                held.append((np.array([i]), np.array(ids, np.int32)))
        if with_ids:
            self.starts = np.r_[0, np.cumsum(self.counts)]
            self.flat = np.empty(int(self.starts[-1]), np.int32)
            for chosen, ids in held:
                self.flat[places(self.starts[chosen], self.counts[chosen])] = ids

    def _run(self, chosen: list[int], words: list[str], v: Vocabulary, held: list | None) -> None:
        own = [words[i] for i in chosen]
        size = np.fromiter(map(len, own), np.int64, len(own))
        points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        depth = int(size.max())
        inside = np.arange(depth) < size[:, None]
        letter = np.full((len(own), depth), -1, np.int32)
        letter[inside] = v.letter_of[points]
        raw = np.full((len(own), depth), 0xFFFFFFFF, np.uint32)
        raw[inside] = points
        shared = np.zeros(len(own), np.int64)
        shared[1:] = np.cumprod(raw[1:] == raw[:-1], axis=1).sum(1)
        new = inside & (np.arange(depth) >= shared[:, None])
        node = np.zeros((len(own), depth + 1), np.int32)  # column d: the node after d characters, 0 the root
        fresh = np.zeros_like(node)
        fresh[:, 1:][new] = np.arange(1, int(new.sum()) + 1)
        np.maximum.accumulate(fresh, axis=0, out=node)
        total = int(new.sum()) + 1
        self.nodes += total - 1
        best, count = np.full(total, -np.inf), np.zeros(total, np.int32)
        back, piece = np.zeros(total, np.int8), np.full(total, -1, np.int32)
        best[0] = 0.0
        for d in range(1, depth + 1):
            row = np.flatnonzero(new[:, d - 1])
            if len(row) == 0:
                continue
            here = node[row, d]
            unknown = letter[row, d - 1] == 0
            if unknown.any():
                r, h = row[unknown], here[unknown]
                point = raw[r, d - 1]
                width = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
                best[h] = best[node[r, d - 1]] + v.unknown
                count[h] = count[node[r, d - 1]] + width
                back[h] = 1
            row, here = row[~unknown], here[~unknown]
            state = v.first[letter[row, d - 1]]
            for k in range(1, min(v.longest, d) + 1):
                if k > 1:
                    state = v.step(state, letter[row, d - k])
                alive = state > 0
                row, here, state = row[alive], here[alive], state[alive]
                if len(row) == 0:
                    break
                before = node[row, d - k]
                value = best[before] + v.end_score[state]
                better = value > best[here]
                h, b = here[better], before[better]
                best[h], count[h] = value[better], count[b] + 1
                back[h], piece[h] = k, v.end_id[state[better]]
        ends = node[np.arange(len(own)), size]
        self.counts[chosen] = count[ends]
        if held is None:
            return
        out = np.empty(int(count[ends].sum()), np.int32)
        free = np.cumsum(count[ends], dtype=np.int64)  # ids are written from each pre-token's end backwards
        rows, at = np.arange(len(own)), size.copy()
        while len(rows):
            n = node[rows, at]
            known = piece[n] >= 0
            free[rows[known]] -= 1
            out[free[rows[known]]] = piece[n[known]]
            for r, d in zip(rows[~known], at[~known]):
                for x in reversed(own[r][d - 1].encode("utf-8", "surrogatepass")):
                    free[r] -= 1
                    out[free[r]] = v.byte_id[x]
            at = at - back[n]
            rows, at = rows[at > 0], at[at > 0]
        held.append((np.array(chosen), out))


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs that start and extend as given, one run after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def numbered(forms: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct pre-tokens of normal forms, and each form as their numbers."""
    found = [PRE_TOKEN.findall(form) for form in forms]
    distinct = dict.fromkeys(chain.from_iterable(found))
    number = dict(zip(distinct, range(len(distinct))))
    return list(distinct), [np.fromiter(map(number.__getitem__, f), np.int64, len(f)) for f in found]


def text_chunks(column, characters: int = 4_000_000):
    """Runs of rows (start, texts) that hold about so many characters, or one longer text."""
    rows, start, total = [], 0, 0
    for at, value in enumerate(column):
        value = value.as_py()
        rows.append(value)
        total += len(value or "")
        if total >= characters:
            yield start, rows
            rows, start, total = [], at + 1, 0
    if rows:
        yield start, rows
