"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact confirmation.

1. Each text becomes the set of its word shingles, a signature of minima and one hash per band.
2. Texts with equal sets form a class before anything is compared, so a third of all rows may be copies.
3. Classes that share a band are compared in blocks. A pair is taken up in the first band the two share;
   their signatures are compared in batches and the pair is dropped as soon as the posterior probability
   of reaching the threshold falls below the chosen miss probability.
4. Survivors are confirmed on the full shingle sets. Sets travel once per pair of blocks, and a task
   returns a spanning forest of the links it confirms, never all pairs of a group.
5. Components of the confirmed links give each document the smallest id that it reaches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdrift.llm.components import components
from sparkdrift.llm.frames import binary_rows, blocked, col, map_groups, stored, to_batch

MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Setting:
    """What counts as a near copy and how it is searched.

    A pair at the threshold of 0.85 shares one of 24 bands of 6 minima with probability 0.99999.
    ``miss`` bounds the posterior probability at which a candidate is given up, for each batch looked at.
    """

    percent: int = 85
    words: int = 5
    bands: int = 24
    rows: int = 6
    batch: int = 36
    miss: float = 1e-5
    block_rows: int = 256
    block_shingles: int = 1_000_000
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z is lower-cased and words end at ASCII white space. Fewer words than a shingle form one shingle
    that is unlike any longer one; no words give the empty set.
    """
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if n == 0:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter((digest(w) for w in found), np.uint64, n)
    factors = _factors(words + 1)
    width = min(n, words)
    mixed = np.full(n - width + 1, (width * int(factors[words])) & MASK, np.uint64)
    for k in range(width):
        mixed += each[k : n - width + 1 + k] * factors[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@lru_cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], setting: Setting) -> np.ndarray:
    """Minima of ``setting.hashes`` hash functions, one row per non-empty set."""
    rng = np.random.default_rng(setting.seed)
    odd = rng.integers(0, 1 << 31, setting.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, setting.hashes, dtype=np.uint32)
    out = np.empty((len(sets), setting.hashes), np.uint32)
    at = 0
    while at < len(sets):  # pieces that stay in the processor's cache, or one longer set
        end, total = at + 1, len(sets[at])
        while end < len(sets) and total + len(sets[end]) <= 32_768:
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k in range(setting.hashes):
            out[at:end, k] = np.minimum.reduceat((flat ^ flip[k]) * odd[k], starts)
        at = end
    return out


DESCRIBED = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("print", pa.string()), ("signature", pa.binary())])


def describe(docs: DataFrame, key: str, text: str, setting: Setting) -> DataFrame:
    """(key, mark, n, print, signature): a hash of the text, the shingle count, a 128-bit fingerprint of the
    set, and the minima.

    Fingerprint and signature are null for an empty set.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_hashes(x, setting.words) for x in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                minima = iter(signatures(full, setting))
                yield to_batch(
                    DESCRIBED,
                    part.column(0),
                    part.column(2),
                    [len(s) for s in sets],
                    [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
                    [next(minima).tobytes() if len(s) else None for s in sets],
                )

    frame = docs.select(
        col(key).cast("long").alias("key"), col(text).cast("string").alias("text"), F.xxhash64(col(text)).alias("mark")
    )
    return frame.mapInArrow(run, "key long, mark long, n long, print string, signature binary")


@dataclass
class Bayes:
    """Least number of equal minima, after each batch, at which a pair may still reach the threshold.

    Similarity has a uniform prior, so m equal minima of n give a Beta(m + 1, n - m + 1) posterior.
    """

    setting: Setting
    ends: list[int] = field(init=False)
    least: list[int] = field(init=False)

    def __post_init__(self) -> None:
        s = self.setting
        self.ends = [*range(s.batch, s.hashes, s.batch), s.hashes]
        self.least = [next(m for m in range(n + 1) if self.above(m, n) >= s.miss or m == n) for n in self.ends]

    def above(self, m: int, n: int) -> float:
        """Posterior probability that the similarity is at the threshold or above.

        For whole numbers this Beta tail is a binomial sum: P(X <= m) of n + 1 trials at the threshold.
        """
        t = self.setting.percent / 100
        return math.fsum(math.comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))

    def survivors(self, left: np.ndarray, right: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of two signature blocks that no batch rules out, found 64 rows at a time."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        first, end = self.least[0], self.ends[0]
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            same = np.zeros((len(part), len(right)), np.int16)
            for k in range(end):
                same += part[:, k, None] == right[None, :, k]
            i, j = np.nonzero(same >= first)
            same = same[i, j].astype(np.int64)
            i += at
            if upper:
                keep = i < j
                i, j, same = i[keep], j[keep], same[keep]
            for low, high, least in zip(self.ends, self.ends[1:], self.least[1:]):
                if len(i) == 0:
                    break
                same = same + (left[i, low:high] == right[j, low:high]).sum(1)
                keep = same >= least
                i, j, same = i[keep], j[keep], same[keep]
            found.append((i, j))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def candidate_pairs(classes: DataFrame, setting: Setting) -> DataFrame:
    """(a, partners, hub): for class a the larger classes that survive signature comparison with it.

    hub is the smallest class that the pairs found in the same task connect a with, so (a, hub) alone tell
    which classes hang together.
    """
    bands, rows, seed = setting.bands, setting.rows, setting.seed
    members = pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("member", pa.int64())])

    def band_rows(batches):
        for batch in batches:
            minima, at = binary_rows(batch.column(1), "<u4")
            if batch.num_rows == 0:
                continue
            minima = np.ascontiguousarray(minima.reshape(batch.num_rows, bands * rows))
            key = batch.column(0).to_numpy()
            for band in range(bands):
                part = np.ascontiguousarray(minima[:, band * rows : (band + 1) * rows])
                bucket = [xxhash.xxh3_64_intdigest(x.tobytes(), seed) for x in part]
                yield to_batch(
                    members, np.full(len(key), band, np.int32), np.array(bucket, np.uint64).view(np.int64), key
                )

    banded = classes.select("key", "signature").mapInArrow(band_rows, "band int, bucket long, member long")
    dealt = blocked(banded, ["band", "bucket"], "member", setting.block_rows)
    full = dealt.join(classes.select(F.col("key").alias("member"), "signature"), "member")
    out = pa.schema([("a", pa.int64()), ("partners", pa.list_(pa.int64())), ("hub", pa.int64())])
    bayes = Bayes(setting)

    def compare(table, starts):
        ends = np.append(starts[1:], table.num_rows)
        member = table.column("member").to_numpy()
        own, block_a = table.column("own").to_numpy(), table.column("block_a").to_numpy()
        block_b, band = table.column("block_b").to_numpy(), table.column("band").to_numpy()
        minima, _ = binary_rows(table.column("signature"), "<u4")
        minima = minima.reshape(table.num_rows, bands * rows)
        firsts, seconds = [], []
        for s, e in zip(starts, ends):
            if e - s < 2:
                continue
            is_left = own[s:e] == block_a[s]
            inside = block_a[s] == block_b[s]
            left = np.flatnonzero(is_left) + s
            right = left if inside else np.flatnonzero(~is_left) + s
            if len(right) == 0 or len(left) == 0:
                continue
            i, j = bayes.survivors(minima[left], minima[right], inside)
            i, j = left[i], right[j]
            if band[s] and len(i):  # an earlier common band has this pair
                width = int(band[s]) * rows
                same = (minima[i, :width] == minima[j, :width]).reshape(len(i), int(band[s]), rows)
                new = ~same.all(2).any(1)
                i, j = i[new], j[new]
            firsts.append(member[i])
            seconds.append(member[j])
        if not firsts:
            return
        x, y = np.concatenate(firsts), np.concatenate(seconds)
        low, high = np.minimum(x, y), np.maximum(x, y)
        keep = low < high
        low, high = low[keep], high[keep]
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        nodes, flat = np.unique(np.concatenate((low, high)), return_inverse=True)
        label = smallest_labels(len(nodes), flat[: len(low)], flat[len(low) :])
        count = np.zeros(len(nodes), np.int64)
        np.add.at(count, flat[: len(low)], 1)
        partners = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(high))
        yield to_batch(out, nodes, partners, nodes[label])

    return map_groups(
        full, ["band", "bucket", "block_a", "block_b"], compare, "a long, partners array<long>, hub long"
    )


def smallest_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, nodes being numbered from 0."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def confirmed_links(pairs: DataFrame, docs: DataFrame, key: str, text: str, setting: Setting) -> DataFrame:
    """(a, b) spanning every component of the candidate pairs whose full sets reach the threshold.

    Families of candidates are dealt to blocks by shingle count. A task gets the sets of two blocks and
    their candidate pairs once, and leaves out pairs that its own links connect already.
    """
    pairs = stored(pairs)
    family = components(pairs.select("a", F.col("hub").alias("b")))
    family = stored(family)

    schema = pa.schema([("member", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def shingled(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_hashes(x, setting.words) for x in part.column(1).to_pylist()]
                yield to_batch(schema, part.column(0), [len(s) for s in sets], [s.tobytes() for s in sets])

    texts = docs.select(col(key).cast("long").alias("node"), col(text).cast("string").alias("text"))
    sets = stored(
        texts.join(family, "node")
        .groupBy("node")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .mapInArrow(shingled, "member long, n long, shingles binary")
    )
    sizes = sets.select("member", "n").join(family.withColumnRenamed("node", "member"), "member")
    total = sizes.groupBy("component").agg(F.sum("n").alias("shingle_sum"), F.count(F.lit(1)).alias("members"))
    wanted = F.greatest(
        F.ceil(F.col("shingle_sum") / setting.block_shingles), F.ceil(F.col("members") / setting.block_rows)
    )
    blocks = stored(total.select("component", wanted.cast("int").alias("blocks")))

    def block_of(member):
        return F.pmod(F.xxhash64(member, F.lit(23)), F.col("blocks")).cast("int")

    placed = stored(
        family.withColumnRenamed("node", "member")
        .join(blocks, "component")
        .select("member", "component", "blocks", block_of(F.col("member")).alias("block"))
    )
    at_b = F.transform("partners", block_of)
    work = stored(
        pairs.where(F.size("partners") > 0)
        .join(placed.withColumnRenamed("member", "a"), "a")
        .withColumn("of_b", F.explode(F.array_distinct(at_b)))
        .withColumn("partners", F.filter("partners", lambda p: block_of(p) == F.col("of_b")))
        .groupBy(
            "component",
            F.least("block", "of_b").alias("block_a"),
            F.greatest("block", "of_b").alias("block_b"),
            "a",
        )
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("partners")))).alias("partners"))
    )
    needed = work.select("component", "block_a", "block_b").distinct()
    ends = F.array_distinct(F.array("block_a", "block_b"))
    spots = stored(needed.select("component", "block_a", "block_b", F.explode(ends).alias("block")))
    none = F.lit(None)
    items = (
        placed.join(spots, ["component", "block"])
        .join(sets, "member")
        .select(
            "component", "block_a", "block_b", F.lit(0).alias("kind"), "member", "shingles",
            none.cast("array<long>").alias("partners"),
        )
        .union(
            work.select(
                "component", "block_a", "block_b", F.lit(1).alias("kind"), F.col("a").alias("member"),
                none.cast("binary").alias("shingles"), "partners",
            )
        )
    )
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(table, starts):
        ends = np.append(starts[1:], table.num_rows)
        kind, member = table.column("kind").to_numpy(), table.column("member").to_numpy()
        flat_sets, at = binary_rows(table.column("shingles"), "<u8")
        partners = table.column("partners").combine_chunks()
        partners = partners if isinstance(partners, pa.ListArray) else pa.concat_arrays(partners.chunks)
        links: list[tuple[int, int]] = []
        for s, e in zip(starts, ends):
            cut = int(s + np.searchsorted(kind[s:e], 1))
            names = {int(m): k for k, m in enumerate(member[s:cut])}
            _, local = np.unique(flat_sets[at[s] : at[cut]], return_inverse=True)
            offset = at[s : cut + 1] - at[s]
            mark = np.zeros(len(local) + 1, bool)
            parent = list(range(len(names)))

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for row in range(cut, e):
                x = names.get(int(member[row]))
                if x is None:
                    continue
                mine = local[offset[x] : offset[x + 1]]
                mark[mine] = True
                for other in partners[row].as_py():
                    y = names.get(other)
                    if y is None or root(x) == root(y):
                        continue
                    theirs = local[offset[y] : offset[y + 1]]
                    common = int(mark[theirs].sum())
                    if 100 * common >= setting.percent * (len(mine) + len(theirs) - common):
                        parent[root(x)] = root(y)
                        links.append((int(member[s + x]), other))
                mark[mine] = False
        if links:
            found = np.array(links, np.int64)
            yield to_batch(out, found[:, 0], found[:, 1])

    return map_groups(items, ["component", "block_a", "block_b"], confirm, "a long, b long", ["kind", "member"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", setting: Setting = Setting()) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when their shingle sets overlap in ``percent`` of the union; component_id is the
    smallest key reachable by links and kept marks it. Null and wordless texts link with nothing. Rows that
    repeat a key are given back as often as they come; they should carry the same text, and where they do
    not, only the text with the smallest hash takes part, and the others link with nothing. A null key never joins anything:
    its component_id is null and it is kept. Other columns of ``docs`` are ignored, whatever their names.
    """
    described = stored(describe(docs, key, text, setting))
    classes = stored(
        described.where("print is not null and key is not null")
        .groupBy("print")
        .agg(F.min("key").alias("key"), F.min_by("mark", "key").alias("mark"), F.first("signature").alias("signature"))
        .groupBy("key")
        .agg(F.min_by(F.struct("print", "signature"), "mark").alias("own"))
        .select("key", "own.*")
    )
    pairs = candidate_pairs(classes.select("key", "signature"), setting)
    links = stored(confirmed_links(pairs, docs, key, text, setting))
    reached = stored(components(links))
    least = classes.select("print", F.col("key").alias("node")).join(reached, "node", "left")
    least = stored(least.select("print", F.coalesce("component", "node").alias("component")))
    rows = described.select("key", "n", "print")
    joined = rows.join(least, "print", "left")
    component = F.coalesce("component", "key")
    kept = F.coalesce(component == F.col("key"), F.lit(True))
    return joined.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), component).alias("component_id"),
        kept.alias("kept"),
    )
