"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nyström landmarks.

The kernel compares two words by the three-letter subsequences they share. A subsequence may skip letters;
each skipped letter costs a factor, so "stxupid" and "s-t-u-p-i-d" stay close to the word they hide. Words
are divided by their norms, so that length and repetition don't count.

Training sees labelled texts word by word. A toxic text has harmless words too, so the machine is trained
as for multiple instances: words of toxic texts that it finds harmless stop counting as toxic, and it is
trained again. Then variants of the words that were found most toxic, with a letter put in or left out, join the toxic
examples, so that disguised words reach the margin too. Landmarks are words; the Nyström map is linear in the subsequences, so the trained machine
folds into one weight per subsequence, and scoring a text needs neither landmarks nor a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkdrift.llm.frames import col, free_name, stored

CLASSES = 64
#: Offsets of the second and third letter of a subsequence, with up to two letters skipped, and the factor
#: for each skipped letter.
OFFSETS = [(a, b) for b in range(2, 5) for a in range(1, b)]
DECAY = 0.8
EMPTY_MARGIN = -2.0
#: Words whose features are worked out and held together.
BLOCK = 2048
#: How far a word may be inside its margin without joining the working set: the size of rounding errors.
SETTLED = 1e-4
NEAR = -0.6
#: Stands before runs of letters where they are counted beside words; no word has it.
PART = "\x00"

#: Letters that stand for others in disguised words; fixed values.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
NOT_LETTERS = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Setting:
    """Bounds of the training sample, and the machine's size.

    The machine is fitted on at most ``toxic_rows`` and ``clean_rows`` labelled texts, taken by a hash of
    their id, and on all words of these. It starts from ``words`` of them, half the most frequent ones, half
    those with the largest excess in toxic texts, and takes in the others until none is on the wrong side of
    its margin: the rest would not change it. Words with a likelihood ratio statistic above ``hint``, or half the largest
    one if that is less, start as toxic examples.
    Scoring reads everything.
    """

    toxic_rows: int = 2_000
    clean_rows: int = 4_000
    words: int = 30_000
    landmarks: int = 256
    rounds: int = 4
    hint: float = 20.0
    ridge: float = 0.1
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """Weights by subsequence, the bias, and what turns a text's two largest margins into a score.

    ``insults`` are the words found most toxic and their variants, which the score is set by as well.
    """

    weights: np.ndarray
    bias: float
    slopes: tuple[float, float] = (1.0, 0.0)
    shift: float = 0.0
    insults: tuple[str, ...] = ()


def words_of(text: str | None) -> dict[str, int]:
    """The normal forms of a text's words and how often they occur.

    Letters are lower-cased, runs of single letters set apart are joined, and in words that hold anything
    but letters, look-alikes become letters and the rest is dropped.
    """
    if not text:
        return {}
    lowered = SPACED.sub(lambda m: "".join(m[0].split()), text.lower())
    out: dict[str, int] = {}
    for word, count in Counter(lowered.split()).items():
        if not word.isalpha():
            word = NOT_LETTERS.sub("", word.translate(LOOKALIKES))
        if word:
            out[word] = out.get(word, 0) + count
    return out


def _classes(points: np.ndarray) -> np.ndarray:
    """Letters a-z keep classes of their own; every other code point shares one of the rest."""
    letter = (points >= 97) & (points <= 122)
    rest = 28 + (points.astype(np.uint64) * np.uint64(7)) % np.uint64(CLASSES - 28)
    return np.where(letter, points - 95, np.where(points == 2, 0, np.where(points == 3, 1, rest))).astype(np.int32)


def subsequences(words: list[str]):
    """For each of OFFSETS: the ids of all subsequences, their word and their weight.

    Words are fenced by two end marks, so that short words have subsequences and ends of words differ
    from their middles.
    """
    joined = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    letters = _classes(points).astype(np.int64)
    for a, b in OFFSETS:
        n = len(letters) - b
        if n <= 0:
            continue
        inside = np.flatnonzero(owner[:n] == owner[b:])
        ids = (letters[inside] * CLASSES + letters[inside + a]) * CLASSES + letters[inside + b]
        yield ids, owner[inside], DECAY ** (b - 2)


def norms(words: list[str]) -> np.ndarray:
    """Each word's kernel value with itself, square root."""
    found = list(subsequences(words))
    if not found:
        return np.ones(len(words))
    key = np.concatenate([owner.astype(np.int64) * CLASSES**3 + ids for ids, owner, _ in found])
    load = np.concatenate([np.full(len(ids), weight) for ids, _, weight in found])
    named, at = np.unique(key, return_inverse=True)
    square = np.bincount(at, load) ** 2
    return np.sqrt(np.maximum(np.bincount(named // CLASSES**3, square, len(words)), 1e-12))


def least_norms(words: list[str]) -> np.ndarray:
    """The norm that a word of this length has at least, reached where no subsequence repeats."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    total = np.zeros(len(words))
    for _, b in OFFSETS:
        total += np.maximum(lengths - b, 0) * DECAY ** (2 * (b - 2))
    return np.sqrt(np.maximum(total, 1e-12))


def margins(words: list[str], model: Model) -> np.ndarray:
    """The machine's value for each word; for words below NEAR an upper bound, which is cheaper."""
    total = np.zeros(len(words))
    for ids, owner, weight in subsequences(words):
        total += weight * np.bincount(owner, model.weights[ids], len(words))
    out = total / least_norms(words) + model.bias
    near = np.flatnonzero(out > NEAR)
    if len(near):
        out[near] = total[near] / norms([words[i] for i in near]) + model.bias
    return out


@dataclass(frozen=True)
class Landmarks:
    """Subsequence weights of the landmarks divided by their norms, one row for each that occurs in them.

    ``row_of`` has the row of every subsequence; row 0 is empty and stands for all others.
    """

    row_of: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Landmarks:
        found = list(subsequences(words))
        ids = np.unique(np.concatenate([x for x, _, _ in found]))
        row_of = np.zeros(CLASSES**3, np.int32)
        row_of[ids] = np.arange(1, len(ids) + 1)
        rows = np.zeros((len(ids) + 1, len(words)))
        for x, owner, weight in found:
            np.add.at(rows, (row_of[x], owner), weight)
        return cls(row_of, (rows / norms(words)).astype(np.float32))

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel values of words with the landmarks."""
        out = np.zeros((len(words), self.rows.shape[1]), np.float32)
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            for ids, owner, weight in subsequences(part):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
                if len(starts):
                    shared = np.add.reduceat(self.rows[self.row_of[ids]], starts, axis=0)
                    out[at + owner[starts]] += np.float32(weight) * shared
            out[at : at + 500] /= norms(part)[:, None].astype(np.float32)
        return out

    def fold(self, values: np.ndarray) -> np.ndarray:
        """One weight per subsequence from one value per landmark."""
        return (self.rows @ values).astype(np.float32)[self.row_of]


def squared_hinge(
    blocks: list[np.ndarray], toxic: np.ndarray, clean: np.ndarray, w: np.ndarray, ridge: np.ndarray
) -> np.ndarray:
    """Weights after Newton steps on the squared hinge loss; each row of the blocks may count for both sides.

    Blocks have at most BLOCK rows, so memory stays near theirs.
    """
    for _ in range(12):
        curve, pull = ridge.copy(), np.zeros(len(w))
        at = 0
        for block in blocks:
            part = block.astype(np.float64)
            value = part @ w
            up = np.where(value < 1, toxic[at : at + len(block)], 0.0)
            down = np.where(value > -1, clean[at : at + len(block)], 0.0)
            curve += part.T @ (part * (up + down)[:, None])
            pull += part.T @ (up - down)
            at += len(block)
        new = np.linalg.solve(curve, pull)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


class Machine:
    """The machine while it is fitted: its weights, and the features of the words it works on.

    ``solve`` minimises the loss over all words. Words that are on the right side of their margin add nothing
    to it, so the weights are found for the working set, all words are looked at, those on the wrong side
    join the set, and this goes on until none does. Only the working set's features are held.
    """

    def __init__(self, words: list[str], marks: Landmarks, root: np.ndarray, ridge: float):
        self.words, self.marks, self.root = words, marks, root
        self.norms = np.concatenate([norms(words[at : at + BLOCK]) for at in range(0, len(words), BLOCK)])
        self.place = np.full(len(words), -1, np.int64)
        self.members = np.zeros(0, np.int64)
        self.blocks: list[np.ndarray] = []
        self.w = np.zeros(root.shape[1] + 1)
        self.ridge = ridge * np.eye(len(self.w))
        self.ridge[-1, -1] = 1e-6

    def features(self, words: list[str]) -> list[np.ndarray]:
        """The features of words, in blocks."""
        out, root = [], self.root.astype(np.float32)
        for at in range(0, len(words), BLOCK):
            part = words[at : at + BLOCK]
            out.append(np.ones((len(part), len(self.w)), np.float32))
            out[-1][:, :-1] = self.marks.kernel(part) @ root
        return out

    def take(self, rows: np.ndarray) -> int:
        """Add words to the working set; how many are new."""
        fresh = rows[self.place[rows] < 0]
        self.place[fresh] = np.arange(len(self.members), len(self.members) + len(fresh))
        self.members = np.concatenate([self.members, fresh])
        self.blocks += self.features([self.words[i] for i in fresh])
        return len(fresh)

    def values(self) -> np.ndarray:
        """The margin of every word, by one weight per subsequence."""
        weights, out = self.marks.fold(self.root @ self.w[:-1]), np.zeros(len(self.words))
        for at in range(0, len(self.words), BLOCK):
            part = self.words[at : at + BLOCK]
            for ids, owner, weight in subsequences(part):
                out[at : at + BLOCK] += weight * np.bincount(owner, weights[ids], len(part))
        return out / self.norms + self.w[-1]

    def solve(self, toxic: np.ndarray, clean: np.ndarray, extra: list[str] = (), extra_toxic: np.ndarray | None = None) -> np.ndarray:
        """Fit to words that count so much on each side, and to extra toxic ones; all words' margins."""
        more = self.features(list(extra))
        more_toxic = np.zeros(0) if extra_toxic is None else extra_toxic
        while True:
            up, down = np.r_[toxic[self.members], more_toxic], np.r_[clean[self.members], np.zeros(len(more_toxic))]
            self.w = squared_hinge([*self.blocks, *more], up, down, self.w, self.ridge)
            value = self.values()
            wrong = ((toxic > 0) & (value < 1 - SETTLED)) | ((clean > 0) & (value > -1 + SETTLED))
            if not self.take(np.flatnonzero(wrong)):
                return value


def surplus(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Likelihood ratio statistic of occurring in toxic texts more often than their ``share`` of texts.

    Negative where it is less often.
    """
    n = toxic + clean
    seen = 2 * np.where(toxic > 0, toxic * np.log(np.maximum(toxic, 1e-9) / np.maximum(n * share, 1e-9)), 0.0)
    seen += 2 * np.where(clean > 0, clean * np.log(np.maximum(clean, 1e-9) / np.maximum(n * (1 - share), 1e-9)), 0.0)
    return np.where(toxic > n * share, seen, -seen)


def parts_of(words: list[str]) -> set[str]:
    """Runs of three letters in these words, ends of words being marked."""
    fenced = [f"\x02{w}\x03" for w in words]
    return {w[i : i + 3] for w in fenced for i in range(len(w) - 2)}


def evidence(words: list[str], counts: dict[str, tuple[int, int]], share: float) -> np.ndarray:
    """The largest surplus of a word itself, or of three letters in a row that it holds.

    ``counts`` has the toxic and the clean texts with each word and each run. Only what is found in toxic
    texts more than three times as often as in clean ones is evidence.
    """
    names = list(counts)
    both = np.array([counts[x] for x in names], float).reshape(-1, 2)
    value = np.where(both[:, 0] > 3 * both[:, 1], surplus(both[:, 0], both[:, 1], share), 0.0)
    known = dict(zip(names, value.tolist()))
    return np.array([max(known.get(x, 0.0) for x in (w, *parts_of([w]))) for w in words])


def variants(word: str) -> list[str]:
    """The word with one letter put in between two others, or with one inner letter left out.

    The letters put in are a fixed draw by the word; words of fewer than four letters have no variants.
    """
    if len(word) < 4:
        return []
    rng = np.random.default_rng(list(word.encode("utf-8", "surrogatepass")))
    letters = [chr(97 + x) for x in rng.integers(0, 26, 3 * len(word))]
    added = [word[:i] + letters[3 * i + k] + word[i:] for i in range(1, len(word)) for k in range(3)]
    return list(dict.fromkeys([*added, *(word[:i] + word[i + 1 :] for i in range(1, len(word) - 1))]))


def fit(
    words: list[str], counts: dict[str, tuple[int, int]], texts: tuple[int, int], setting: Setting
) -> Model | None:
    """The machine for words that occur in so many of the toxic and clean training ``texts``.

    It comes without its line. Half of the landmarks are the words most typical of toxic texts, the others
    are spread over the rest.
    Squared hinge loss with a ridge is minimised by Newton steps. None without words of both kinds.
    """
    if not words or not all(texts):
        return None
    toxic, clean = np.array([counts[w] for w in words], float).T
    share = texts[0] / (texts[0] + texts[1])
    hint = evidence(words, counts, share)
    typical = toxic > 3 * clean
    ranked = np.lexsort((np.arange(len(words)), -np.where(typical, hint, -1.0)))
    half = min(len(words), setting.landmarks // 2)
    chosen = list(ranked[:half])
    others = ranked[half:]
    chosen += list(others[:: max(1, len(others) // max(1, setting.landmarks - half))][: setting.landmarks - half])
    marks = Landmarks.of([words[i] for i in chosen])
    among = marks.kernel([words[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-3 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    machine = Machine(words, marks, root, setting.ridge)
    machine.take(np.argsort(-(toxic + clean), kind="stable")[: setting.words // 2])
    machine.take(np.argsort(clean * texts[0] - toxic * texts[1], kind="stable")[: setting.words // 2])
    first = typical & (hint > min(setting.hint, hint.max() / 2))
    weight_toxic, weight_clean = np.where(first, np.sqrt(toxic), 0.0), np.sqrt(clean)
    if not weight_toxic.any():
        weight_toxic = np.sqrt(toxic)
    for _ in range(setting.rounds):
        value = machine.solve(weight_toxic, weight_clean)
        witness = (value > 0) & typical
        if not witness.any():
            break
        weight_toxic = np.where(witness, np.sqrt(toxic), 0.0)
    own = np.where(typical, surplus(toxic, clean, share), 0.0)
    sure = np.flatnonzero((value > 0) & typical & (own > 0) & (own >= own.max() / 4))
    known = set(words)
    extra = {v: np.sqrt(toxic[i]) for i in sure for v in variants(words[i]) if v not in known}
    if extra:
        machine.solve(weight_toxic, weight_clean, list(extra), np.fromiter(extra.values(), float, len(extra)))
    w = machine.w
    insults = (*(words[i] for i in sure), *extra)
    return Model(marks.fold(root @ w[:-1]), float(w[-1]), insults=insults)


def calibrated(margin: np.ndarray, toxic: np.ndarray, model: Model) -> Model:
    """The model with a logistic function of the two largest margins of labelled texts, by Newton steps.

    Each clean text counts as a toxic one too, as if it held one of the model's insults.
    """
    toxic = toxic.astype(bool)
    if model.insults and (~toxic).any():
        single = margin[~toxic]
        value = np.resize(margins(list(model.insults), model), len(single))
        margin = np.vstack([margin, np.sort(np.column_stack([single, value]), axis=1)[:, :0:-1]])
        toxic = np.r_[toxic, np.ones(len(single), bool)]
    ends = (1 + toxic.sum()) / (2 + toxic.sum()), 1 / (2 + (~toxic).sum())
    target = np.where(toxic, ends[0], ends[1])
    x = np.column_stack([margin, np.ones(len(margin))])
    ridge = np.array([0.05, 0.05, 0.0])
    w = np.array([1.0, 1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge * w
        curve = x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-6)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    slopes = float(max(w[0], 0.0)), float(max(w[1], 0.0))
    return Model(model.weights, model.bias, slopes, float(w[2]), model.insults)


def held_out(key):
    """True for rows whose labels are never learnt from."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def two_largest(counts: list[dict[str, int]], model: Model) -> np.ndarray:
    """The largest and second largest margin of each text's words, a word counting as often as it occurs.

    EMPTY_MARGIN stands where there are fewer words.
    """
    numbers = dict.fromkeys(w for own in counts for w in own)
    numbers = dict(zip(numbers, range(len(numbers))))
    out = np.full((len(counts), 2), EMPTY_MARGIN)
    if not numbers:
        return out
    each = margins(list(numbers), model)
    for row, own in enumerate(counts):
        if own:
            names = list(own)
            values = each[[numbers[w] for w in names]]
            top = int(values.argmax())
            out[row] = values[top]
            if own[names[top]] == 1:
                values[top] = -np.inf
                out[row, 1] = max(values.max(), EMPTY_MARGIN)
    return out


def largest_margins(docs: DataFrame, text: str, model: Model, names: list[str]) -> DataFrame:
    """``docs`` with the two largest margins of each text's words."""
    schema = StructType([*docs.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = two_largest([words_of(x) for x in part.column(place).to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found[:, 0]), pa.array(found[:, 1])], names=[*part.schema.names, *names]
                )

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, setting: Setting) -> Model | None:
    """A model from labelled rows that are not held out, or None where they lack toxic or clean texts."""
    labelled = labels.select(col(key).alias("k"), col(label).cast("int").alias("y")).where("k is not null")
    labelled = labelled.where("y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    labelled = labelled.where(~held_out(F.col("k")))
    order = [F.xxhash64("k", F.lit(11)), F.col("k")]
    sample = labelled.where("y = 1").orderBy(*order).limit(setting.toxic_rows)
    sample = sample.union(labelled.where("y = 0").orderBy(*order).limit(setting.clean_rows))
    texts = docs.select(col(key).alias("k"), col(text).cast("string").alias("text"))
    # The limits above bound the broadcast side.
    sample = texts.join(F.broadcast(sample), "k").select("text", "y")

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for value, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words_of(value)
                for name in (*own, *(PART + x for x in parts_of(own))):
                    seen.setdefault(name, [0, 0])[1 - y] += 1
            both = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])],
                names=["word", "toxic", "clean"],
            )

    texts = {row["y"]: row["count"] for row in sample.groupBy("y").count().collect()}
    texts = texts.get(1, 0), texts.get(0, 0)
    if not all(texts):
        return None
    counted = stored(
        sample.mapInArrow(count, "word string, toxic long, clean long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    # All words and runs of letters of the sample, whose rows are bounded.
    rows = counted.orderBy("word").toPandas()
    pairs = list(zip(rows["toxic"].tolist(), rows["clean"].tolist()))
    counts = {name.removeprefix(PART): pair for name, pair in zip(rows["word"].tolist(), pairs)}
    words = [w for w in rows["word"].tolist() if not w.startswith(PART)]
    del rows, pairs
    model = fit(words, counts, texts, setting)
    if model is None:
        return None
    shown = largest_margins(sample, "text", model, ["first", "second"]).select("first", "second", "y").toPandas()
    return calibrated(shown[["first", "second"]].to_numpy(float), shown["y"].to_numpy(), model)


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", setting: Setting = Setting()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Rows are scored one by one by their text alone, so repeated rows get the same result. Null, empty and
    wordless texts get the lowest score the model gives; without a model every score is 0. New columns whose
    names are taken get underscores at their end.
    """
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    if model is None:
        return docs.withColumns({score: F.lit(0.0), predicted: F.lit(0)})
    names = [free_name(docs, "first_margin"), free_name(docs, "second_margin")]
    shown = largest_margins(docs, text, model, names)
    total = col(names[0]) * model.slopes[0] + col(names[1]) * model.slopes[1] + model.shift
    shown = shown.withColumn(score, 1 / (1 + F.exp(-total)))
    return shown.withColumn(predicted, (col(score) >= setting.threshold).cast("int")).drop(*names)
