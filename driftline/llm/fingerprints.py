"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into paragraphs at line breaks, and a paragraph further after
words whose hash is divisible by CUT, so that cuts move along with the text. The
set of paragraph digests is held in cells of count, digests xored and checks
xored; every digest goes to one cell in each of three parts. The cells of two
versions are subtracted, which cancels what they share, and peeled: a cell that
holds a single digest gives it away, and taking it out of its other cells lays
more cells open. If digests are left, both sketches are made anew with more
cells, as many as the share of empty cells suggests. From the differing digests
and the sizes follows the likeness, the Jaccard similarity of the two sets.

A fingerprint is the text form of a sketch of CELLS cells and the number of
digests. Equal texts have equal fingerprints. ``compare`` takes two of them apart
again, subtracts and peels; only where that fails are texts needed.

Defined cases: a null text counts as empty; two texts without words are alike
with 1.0; rows with one id are ordered by text hash and text; null ids come
last; an empty table gives an empty result; the only row follows itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import slices, small_batches
from driftline.llm.hashing import WordHashes, mix, runs

#: Cells of a fingerprint (a multiple of 3), 1 / the share of words that end a
#: paragraph, and the most words in one.
CELLS, CUT, LONGEST = 24, 6, 16
#: Documents compared at once, and ids drawn for each partition to cut the ids into ranges.
BATCH, DRAWN = 256, 64


def digests(text: str, words: WordHashes) -> np.ndarray:
    """The distinct paragraph digests of a text, ascending."""
    hashes, ends = [], []
    for line in text.encode().split(b"\n"):
        if w := line.split():
            hashes += w
            ends.append(len(hashes))
    if not hashes:
        return np.zeros(0, np.uint64)
    h = words.of(hashes)
    cut = h % np.uint64(CUT) == 0
    cut[np.array(ends) - 1] = True
    starts = np.append(0, np.flatnonzero(cut)[:-1] + 1)
    inside = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return np.unique(runs(h, np.flatnonzero(inside % LONGEST == 0)))


def _places(keys: np.ndarray, third: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The three cells of each key; sketches of different sizes place keys differently."""
    salt = third.astype(np.uint64) << np.uint64(32)
    return np.stack([first + j * third + (mix(keys ^ (salt + np.uint64(j + 1))) % third.astype(np.uint64)).astype(np.int64) for j in range(3)])


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


class Cells:
    """Cells of many sketches, one after the other."""

    def __init__(self, sizes: np.ndarray):
        self.third = sizes // 3
        self.first = np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        n = int(sizes.sum())
        self.count, self.keys, self.checks = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> np.ndarray:
        at = _places(keys, self.third[owner], self.first[owner])
        checks = _check(keys)
        for row in at:
            np.add.at(self.count, row, sign)
            np.bitwise_xor.at(self.keys, row, keys)
            np.bitwise_xor.at(self.checks, row, checks)
        return at

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, sign) of all digests that come out."""
        out, at = [], np.arange(len(self.count))
        while len(at):
            at = at[(np.abs(self.count[at]) == 1) & (self.checks[at] == _check(self.keys[at]))]
            if not len(at):
                break
            owner, keys, sign = self.owner[at], self.keys[at], self.count[at]
            _, one = np.unique(np.stack([owner.astype(np.uint64), keys]), axis=1, return_index=True) if len(at) > 1 else (None, np.zeros(1, int))
            owner, keys, sign = owner[one], keys[one], sign[one]
            out.append((owner, keys, sign))
            at = np.unique(self.add(owner, keys, -sign))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def differing(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets, the digests only in the first and only in the second."""
    out: list = [None] * len(pairs)
    todo = np.arange(len(pairs))
    sizes = np.full(len(pairs), cells - cells % 3, np.int64)
    for _ in range(40):
        if not len(todo):
            return out
        parts = [(i, side, s) for i, p in enumerate(todo) for side, s in ((1, pairs[p][0]), (-1, pairs[p][1])) if len(s)]
        sketch = Cells(sizes)
        if parts:
            lengths = [len(s) for _, _, s in parts]
            sketch.add(np.repeat([i for i, _, _ in parts], lengths), np.concatenate([s for _, _, s in parts]), np.repeat(np.array([side for _, side, _ in parts], np.int32), lengths))
        full = np.bincount(sketch.owner[sketch.count != 0], minlength=len(todo)) / sizes
        owner, keys, sign = sketch.peel()
        left = np.bincount(sketch.owner[(sketch.count != 0) | (sketch.keys != 0)], minlength=len(todo))
        order = np.argsort(owner, kind="stable")
        owner, keys, sign = owner[order], keys[order], sign[order]
        bounds = np.searchsorted(owner, np.arange(len(todo) + 1))
        for i in np.flatnonzero(left == 0):
            k, s = keys[bounds[i] : bounds[i + 1]], sign[bounds[i] : bounds[i + 1]]
            out[todo[i]] = (np.sort(k[s > 0]), np.sort(k[s < 0]))
        again = np.flatnonzero(left)
        # d digests leave a share of exp(-3 d / cells) of the cells empty; peeling needs about 1.3 d cells
        total = np.array([len(pairs[p][0]) + len(pairs[p][1]) for p in todo[again]], np.float64)
        guess = -np.log(np.maximum(1.0 - full[again], 1e-9)) * sizes[again] / 3.0
        need = 1.7 * np.minimum(np.where(full[again] < 0.95, 1.3 * guess, total), total) + 12
        sizes = (np.maximum(need, 1.5 * sizes[again]) // 3 + 1).astype(np.int64) * 3
        todo = todo[again]
    for p in todo:  # a digest that equals another's check in 40 sizes: none is known
        a, b = pairs[p]
        out[p] = np.setdiff1d(a, b), np.setdiff1d(b, a)
    return out


def sketch(sets: list[np.ndarray], cells: int = CELLS) -> Cells:
    out = Cells(np.full(len(sets), cells, np.int64))
    lengths = [len(s) for s in sets]
    if sum(lengths):
        out.add(np.repeat(np.arange(len(sets)), lengths), np.concatenate(sets), np.ones(sum(lengths), np.int32))
    return out


def subtracted(a: Cells, b: Cells, left: np.ndarray, right: np.ndarray, cells: int = CELLS) -> Cells:
    """The sketches ``left`` of ``a`` without the sketches ``right`` of ``b``."""
    out = Cells(np.full(len(left), cells, np.int64))
    rows = lambda x, at: x.reshape(-1, cells)[at].reshape(-1)
    out.count = rows(a.count, left) - rows(b.count, right)
    out.keys = rows(a.keys, left) ^ rows(b.keys, right)
    out.checks = rows(a.checks, left) ^ rows(b.checks, right)
    return out


def taken_apart(held: Cells, n: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The digests on either side of ``n`` subtracted sketches; None where peeling leaves some."""
    owner, keys, sign = held.peel()
    left = np.bincount(held.owner[(held.count != 0) | (held.keys != 0)], minlength=n)
    order = np.argsort(owner, kind="stable")
    owner, keys, sign = owner[order], keys[order], sign[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    parts = [(keys[x:y], sign[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
    return [None if gone else (np.sort(k[s > 0]), np.sort(k[s < 0])) for gone, (k, s) in zip(left, parts, strict=True)]


def likeness(sizes: list[tuple[int, int]], found: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Jaccard similarity from the sizes of two sets and what only one of them holds."""
    out = []
    for (a, b), (x, y) in zip(sizes, found, strict=True):
        common = (a + b - len(x) - len(y)) // 2
        out.append(common / (a + b - common) if a + b else 1.0)
    return out


def alike(pairs: list[tuple[np.ndarray, np.ndarray]], held: Cells, cells: int = CELLS) -> list[float]:
    """Likeness of pairs of sets, ``held`` being their subtracted sketches; larger ones are made where these don't do."""
    found = taken_apart(held, len(pairs))
    again = [i for i, x in enumerate(found) if x is None]
    for i, x in zip(again, differing([pairs[i] for i in again], 2 * cells), strict=True):
        found[i] = x
    return likeness([(len(a), len(b)) for a, b in pairs], found)


def written(held: Cells, sizes: list[int], cells: int = CELLS) -> list[str]:
    """The text forms of sketches of ``cells`` cells."""
    out = []
    for i, n in enumerate(sizes):
        s = slice(i * cells, (i + 1) * cells)
        out.append(base64.b64encode(np.array([n, cells], "<u4").tobytes() + held.count[s].astype("<i4").tobytes() + held.keys[s].astype("<u8").tobytes() + held.checks[s].astype("<u4").tobytes()).decode())
    return out


def read(fingerprint: str) -> tuple[int, Cells]:
    """(number of digests, sketch) of a fingerprint."""
    raw = base64.b64decode(fingerprint)
    n, cells = np.frombuffer(raw, "<u4", 2).tolist()
    held = Cells(np.array([cells]))
    held.count = np.frombuffer(raw, "<i4", cells, 8).astype(np.int32)
    held.keys = np.frombuffer(raw, "<u8", cells, 8 + 4 * cells).astype(np.uint64)
    held.checks = np.frombuffer(raw, "<u4", cells, 8 + 12 * cells).astype(np.uint32)
    return n, held


def compare(a: str, b: str) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(likeness, digests only in the first, only in the second) of two fingerprints; None if they need more cells."""
    (n, x), (m, y) = read(a), read(b)
    if len(x.count) != len(y.count):
        return None
    one = np.zeros(1, np.int64)
    (found,) = taken_apart(subtracted(x, y, one, one, len(x.count)), 1)
    return None if found is None else (likeness([(n, m)], [found])[0], *found)


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _below(bounds: list, doc_id: Column) -> Column:
    """How many of the bounds are at or above the id; looked up in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    held = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    group = F.size(F.filter(heads, lambda b: b >= doc_id))
    inside = F.size(F.filter(F.element_at(held, group), lambda b: b >= doc_id))
    return F.when(doc_id.isNull(), F.lit(len(bounds))).when(doc_id > F.lit(bounds[0]), F.lit(0)).otherwise((group - 1) * width + inside)


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs.

    The next document is the one with the next smaller id. Ids are cut into
    ranges at ids that exist; every range is a partition, sorted, and gets the
    first row of the next range besides, so each text is shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    top = ids.agg(F.max("doc_id").alias("top")).collect()[0]["top"]
    # ranges end at exact ids: evenly spaced ones of the DRAWN * n with the smallest hashes
    drawn = sorted(r["doc_id"] for r in ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DRAWN * n).collect())
    bounds = sorted({drawn[i * len(drawn) // n] for i in range(1, n)} - {top} if drawn else set(), reverse=True)
    # a number for each range that falls into a partition of its own
    spread = spark.range(32 * n).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
    names = [r["name"] for r in spread.groupBy("p").agg(F.min("id").alias("name")).orderBy("p").collect()]
    names += range(32 * n, 33 * n)
    label = F.array(*[F.lit(int(x)) for x in names[: len(bounds) + 1]])
    named = source.withColumn("at", _below(bounds, F.col("doc_id")))
    placed = named.select(F.element_at(label, F.col("at") + 1).alias("at"), F.lit(False).alias("ahead"), "doc_id", "text")
    firsts = named.where(F.col("doc_id").isin(bounds + ([top] if top is not None else [])))
    before = F.when(F.col("doc_id") == F.lit(top), F.lit(len(bounds))).otherwise(F.col("at") - 1) if top is not None else F.col("at")
    firsts = firsts.select(F.element_at(label, before + 1).alias("at"), F.lit(True).alias("ahead"), "doc_id", "text")
    rows = placed.unionByName(firsts).repartition(n, "at").sortWithinPartitions("at", "ahead", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()

        def emit(held: list, following: str) -> pa.RecordBatch:
            texts = [t for _, t in held] + [following]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            own, new = [digests(t, words) for t in texts], [digests(t, words) for t in changed]
            k = len(held)
            both, at = sketch(own + new, cells), np.arange(k)
            sizes = [len(s) for s in own + new]
            prints = written(both, sizes, cells)
            prints = prints[:k] + prints[k + 1 :]
            pairs = list(zip(own, new, strict=False)) + list(zip(own, own[1:], strict=False))
            near = alike(pairs, subtracted(both, both, np.append(at, at), np.append(at + k + 1, at + 1), cells), cells)
            columns = [[d for d, _ in held], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in changed], prints[:k], prints[k:], near[:k], near[k:], [len(s) for s in own[:-1]]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)

        held, at, first = [], None, ""
        stream = (r for part in slices(parts) for r in zip(*[c.to_pylist() for c in part.columns], strict=True))
        for name, ahead, doc_id, text in chain(stream, [(None, False, None, "")]):
            if name != at:
                if held:  # no row of a next range: this range follows itself
                    yield emit(held, first)
                held, at, first = [], name, text
            if ahead:
                if held:
                    yield emit(held, text)
                held = []  # further rows of that id
            elif name is not None:
                if len(held) == BATCH:
                    yield emit(held, text)
                    held = []
                held.append((doc_id, text))

    return small_batches(rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs"]
