"""Substring dedup: repeated lines and repeated runs of words, of which the earliest occurrence stays.

Words are normalised (lower case, no punctuation at their ends) and hashed. A
text's units are its lines of at least SHORT words, and, as passages also repeat
inside lines, runs of RUN words that begin at anchors: of the hashes of SHORTER
words, the smallest among each WIDE neighbours is an anchor. Anchors depend on
the words around them only, so equal passages have equal anchors wherever they
stand, and every repeated passage of RUN + WIDE - 1 words holds a unit.

Digests of 128 bits are grouped over all documents; the earliest occurrence, by
id, text and place, is kept. The units that repeat another make stretches; a
stretch is then extended word by word, at most WIDE words at either end, as far
as the text of the kept occurrence agrees, so a passage is found up to its edges.
Stretches of at least ``least_words`` words are removed, with their offsets in
the original text (code points, end exclusive).

Defined cases: null and empty texts have no units; a null id ranks last; rows
that agree in id and text are one occurrence, and all have its spans; rows of
one id, or without one, with different texts are different documents; where a
text repeats itself, words of the kept run stay; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import bitmap, marked, materialize, slices, small_batches
from driftline.llm.hashing import mix

#: Least words of a line that is a unit, and of a stretch that is removed.
SHORT, LEAST_WORDS = 3, 20
#: Words of a run, of an anchor, and the neighbours among which an anchor is the smallest.
RUN, SHORTER, WIDE = 20, 8, 13

_WORD = re.compile(r"\S+")
#: Punctuation that normalising drops, at either end of a word (fixed values).
_DROPPED = ".,;:!?\"'()[]{}<>|*_#-"
#: Bases of the two halves of a digest (odd), and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_steps: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_steps.get(base, ())) < n:
        steps = np.full(2 * n, base, np.uint64)
        steps[0] = 1
        _steps[base] = np.cumprod(steps, dtype=np.uint64)
    return _steps[base][:n]


class PlainHashes(dict):
    """Word -> 64-bit hash of the normalised word, emptied at a quarter million words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.lower().strip(_DROPPED))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Sums:
    """Hashes of runs of a text's words, each from two sums."""

    def __init__(self, h: np.ndarray, half: int):
        self.half = half
        spread = mix(h ^ np.uint64(0xA0761D6478BD642F)) if half else mix(h)
        self.sums = np.append(np.uint64(0), np.cumsum(spread * _powers(_BASES[half], len(h)), dtype=np.uint64))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        lifted = (self.sums[last] - self.sums[first]) * _powers(_INVERSES[self.half], len(self.sums))[first]
        return mix(lifted + (last - first).astype(np.uint64))


def anchors(sums: Sums, n: int) -> np.ndarray:
    """First words of the anchors among ``n`` words: each SHORTER + WIDE - 1 words together hold one that depends on these only."""
    starts = np.arange(max(n - SHORTER + 1, 0))
    if len(starts) < WIDE:
        return starts[:0]
    short = sums.of(starts, starts + SHORTER)
    return np.unique(np.lib.stride_tricks.sliding_window_view(short, WIDE).argmin(axis=1) + starts[: len(starts) - WIDE + 1])


def units(text: str, plain: PlainHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word exclusive, high, low half of the digest) of each unit."""
    lines = [line.split() for line in text.split("\n")]
    h = plain.of([w for line in lines for w in line])
    ends = np.cumsum([len(line) for line in lines])
    starts = np.append(0, ends[:-1])
    own = ends - starts >= SHORT
    low = Sums(h, 0)
    at = anchors(low, len(h))
    at = at[at + RUN <= len(h)]
    first, last = np.append(starts[own], at), np.append(ends[own], at + RUN)
    return first, last, Sums(h, 1).of(first, last), low.of(first, last)


UNIT = "doc_id long, text_hash long, first int, last int, high long, low long"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def text_hash(text: Column) -> Column:
    """With the id, the identity of a row."""
    return F.xxhash64(text, F.length(text))


def unit_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The units of all texts: places count words, last is exclusive."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = PlainHashes()
        for part in slices(parts):
            held = [units(x or "", plain) for x in part.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(part.num_rows), [len(x[0]) for x in held]))
            first, last, high, low = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in range(4))
            columns = [part.column(0).take(row), part.column(1).take(row), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "first", "last", "high", "low"])

    return small_batches(_source(docs, id_col, text_col)).mapInArrow(run, UNIT)


def repeated(found: DataFrame) -> DataFrame:
    """The units that repeat an earlier one: doc_id, text_hash, first, last, and kept (doc_id, text_hash, first) of that.

    The digests that repeat are counted first, which takes no sorting and isn't
    hindered by a common digest; only units that may have one of those (by a
    bitmap) are looked at again, exactly.
    """
    place = F.struct("doc_id", "text_hash", "first")
    twice = materialize(found.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low"), "twice")
    some = materialize(marked(found, bitmap(twice, "high", "low"), "high", "low").where("maybe").drop("maybe"), "some")
    several = some.groupBy(F.col("high").alias("of_high"), F.col("low").alias("of_low")).agg(F.min(place).alias("kept"), F.max(place).alias("other")).where("kept != other").drop("other")
    several = materialize(several, "several")
    both = some.join(several, (F.col("high") == F.col("of_high")) & (F.col("low") == F.col("of_low")))
    return both.where(place != F.col("kept")).select("doc_id", "text_hash", "first", "last", "kept")


KEY = ["doc_id", "text_hash"]


def stretches(again: DataFrame) -> DataFrame:
    """Runs of overlapping or adjacent repeated units: first, last, and where the kept words of both ends lie.

    A unit that repeats one of the same text loses the words that both have.
    """
    own = (F.col("kept.doc_id") == F.col("doc_id")) & (F.col("kept.text_hash") == F.col("text_hash"))
    begin = F.when(own, F.greatest("first", F.col("kept.first") + F.col("last") - F.col("first"))).otherwise(F.col("first"))
    cut = again.select(*KEY, begin.alias("begin"), "last", F.struct(F.col("kept.doc_id"), F.col("kept.text_hash"), (F.col("kept.first") + begin - F.col("first")).alias("at")).alias("left"), F.struct(F.col("kept.doc_id"), F.col("kept.text_hash"), (F.col("kept.first") + F.col("last") - F.col("first")).alias("at")).alias("right"))
    cut = cut.where("begin < last").dropDuplicates([*KEY, "begin", "last"])
    ordered = Window.partitionBy(*KEY).orderBy("begin", "last")
    reached = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = cut.withColumn("reached", reached).withColumn("island", F.sum(F.when(F.col("begin") <= F.col("reached"), 0).otherwise(1)).over(ordered))
    ends = F.min(F.struct("begin", "last", "left")).alias("a"), F.max(F.struct("last", F.negative("begin"), "right")).alias("b"), F.count("*").alias("n_units")
    whole = islands.groupBy(*KEY, "island").agg(*ends)
    return whole.select(*KEY, "island", F.col("a.begin").alias("first"), F.col("b.last").alias("last"), F.col("a.left").alias("left"), F.col("b.right").alias("right"), "n_units")


def surroundings(docs: DataFrame, places: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """For places (doc_id, text_hash, at): hashes of the WIDE words before, nearest first, and after, and where those words begin and end.

    starts[j] is where word at - j begins, ends[j] where word at + j - 1 ends.
    """
    listed = materialize(places.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.array_sort(F.collect_set("at")).alias("places")), "places")
    # of rows that agree in id and text, one
    texts = marked(_source(docs, id_col, text_col), bitmap(listed, "of_id", "of_hash"), *KEY).where("maybe")
    both = texts.join(listed, (F.col("doc_id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))).select(*KEY, "text", "places")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = PlainHashes()
        for part in slices(parts, 128):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, hashed, text, places in zip(*[c.to_pylist() for c in part.columns], strict=True):
                spans = [m.span() for m in _WORD.finditer(text)]
                h = plain.of([text[a:b] for a, b in spans]).view(np.int64)
                for at in places:
                    low, high = max(at - WIDE, 0), min(at + WIDE, len(spans))
                    row = doc_id, hashed, at, h[low:at][::-1], h[at:high], [a for a, _ in spans[low : at + 1]][::-1], [b for _, b in spans[max(at - 1, 0) : high]]
                    for held, x in zip(out, row, strict=True):
                        held.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "text_hash", "at", "before", "after", "starts", "ends"])

    found = both.mapInArrow(run, "doc_id long, text_hash long, at int, before array<long>, after array<long>, starts array<int>, ends array<int>")
    return materialize(found.dropDuplicates([*KEY, "at"]), "around")


def agreeing(a: Column, b: Column) -> Column:
    """How many elements agree from the first on."""
    same = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct(F.when(s["on"] & x["a"].eqNullSafe(x["b"]), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & x["a"].eqNullSafe(x["b"])).alias("on")))
    return same["n"]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, with_key: bool = False) -> DataFrame:
    """doc_id, start, end, n_words, n_units, kept_doc_id of each stretch to remove; ``with_key`` adds text_hash.

    ``n_units`` counts units; ``kept_doc_id`` has the words that the stretch begins with.
    """
    found = materialize(unit_table(docs, id_col=id_col, text_col=text_col), "units")
    long = materialize(stretches(repeated(found)), "stretches")
    places = [long.select(*KEY, F.col(c).alias("at")) for c in ("first", "last")] + [long.select(f"{c}.*") for c in ("left", "right")]
    around = places[0]
    for more in places[1:]:
        around = around.unionByName(more)
    around = surroundings(docs, around.distinct(), id_col=id_col, text_col=text_col)

    def at(rows: DataFrame, key: tuple[str, str, str], **taken: str) -> DataFrame:
        names = [F.col(c).alias(f"of_{c}") for c in (*KEY, "at")] + [F.col(c).alias(n) for n, c in taken.items()]
        same = [F.col(k) == F.col(f"of_{c}") for k, c in zip(key, (*KEY, "at"), strict=True)]
        return rows.join(around.select(*names), same[0] & same[1] & same[2]).drop(*[f"of_{c}" for c in (*KEY, "at")])

    long = long.select("*", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("left", "right") for c in (*KEY, "at")])
    both = at(at(long, (*KEY, "first"), own_before="before", starts="starts"), (*KEY, "last"), own_after="after", ends="ends")
    both = at(at(both, ("left_doc_id", "left_text_hash", "left_at"), kept_before="before"), ("right_doc_id", "right_text_hash", "right_at"), kept_after="after")
    same_text = lambda side: (F.col(f"{side}_doc_id") == F.col("doc_id")) & (F.col(f"{side}_text_hash") == F.col("text_hash"))
    # in one text, the words between two occurrences belong to both and stay
    more = F.when(same_text("left"), 0).otherwise(agreeing(F.col("own_before"), F.col("kept_before")))
    after = F.when(same_text("right"), 0).otherwise(agreeing(F.col("own_after"), F.col("kept_after")))
    wide = both.select(*KEY, (F.col("first") - more).alias("first"), (F.col("last") + after).alias("last"), F.element_at("starts", more + 1).alias("start"), F.element_at("ends", after + 1).alias("end"), "n_units", F.col("left_doc_id").alias("kept_doc_id"))
    # extended stretches may meet
    ordered = Window.partitionBy(*KEY).orderBy("first", "last")
    reached = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    wide = wide.withColumn("reached", reached).withColumn("island", F.sum(F.when(F.col("first") <= F.col("reached"), 0).otherwise(1)).over(ordered))
    whole = wide.groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first")).cast("long").alias("n_words"), F.sum("n_units").alias("n_units"), F.min_by("kept_doc_id", "first").alias("kept_doc_id")).where(F.col("n_words") >= least_words)
    known = lambda c: F.nullif(F.col(c), F.lit(2**63 - 1)).alias(c)
    return whole.select(known("doc_id"), *(["text_hash"] if with_key else []), "start", "end", "n_words", "n_units", known("kept_doc_id"))


def remove(text: Column, spans: Column) -> Column:
    """The text without the spans (structs of start and end, in order, apart)."""
    kept = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.struct(F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0).alias("a"), F.when(i < F.size(spans), F.get(spans, i)["start"]).otherwise(F.length(text)).alias("b")))
    return F.array_join(F.transform(kept, lambda x: text.substr(x["a"] + 1, x["b"] - x["a"])), "")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text without the repeated spans, removed (the spans, with original offsets) of every row."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, least_words=least_words, with_key=True)
    lists = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kept_doc_id"))).alias("removed"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    both = source.join(lists, F.col("doc_id").cast("long").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left").drop("of_id", "of_hash", "text_hash")
    return both.withColumn("text", F.when(F.col("removed").isNotNull(), remove(F.col("text"), F.col("removed"))).otherwise(F.col("text")))
