"""Language identification by a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the blended spectrum of orders 1 to 3: the mean over
the orders of the cosine between the two presence vectors of character n-grams.
n-grams are taken over the whole lower-cased text and hashed into a fixed
number of places for each order. A bounded sample of labelled rows is fitted:
some of its rows are the landmarks, K(x, landmarks) K(landmarks, landmarks)^-1/2
are a text's features, and one ridge regression for each language against the
rest is solved on them. Both products are linear in the presence vectors, so
the fitted model is one matrix for each order, and a batch of texts is scored by
multiplying its presence matrix with it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without labelled rows every text is ``und``; a null id is not held out and not
learned from; repeated rows give repeated results; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import slices, small_batches

#: Places for the n-grams of each order.
PLACES = {1: 1 << 10, 2: 1 << 13, 3: 1 << 15}
#: The sample: rows for each language, rows in all, and those that are landmarks.
ROWS_PER_LANGUAGE, ROWS, LANDMARKS = 400, 4096, 256
RIDGE = 1e-2
#: Parts in which a language's rows are ranked first, so that the last ranking sees at most so many times ROWS_PER_LANGUAGE.
RANK_PARTS = 16
#: Texts scored by one product.
BLOCK = 64
UNKNOWN = "und"


def presence(text: str) -> list[np.ndarray]:
    """For each order, the places (ascending) that the text's n-grams fall into."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint64)
    out = []
    for n, size in PLACES.items():
        if len(codes) < n:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for i in range(n):
            h = (h + codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        seen = np.zeros(size, bool)
        seen[(h & np.uint64(size - 1)).astype(np.int64)] = True
        out.append(np.flatnonzero(seen))
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    languages: list[str]
    matrices: list[np.ndarray]
    offset: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row of regression outputs for each text."""
        total = np.tile(self.offset, (len(texts), 1))
        held = [presence(x) for x in texts]
        for k, matrix in enumerate(self.matrices):
            block = np.zeros((len(texts), len(matrix)), np.float32)
            for i, places in enumerate(held):
                block[i, places[k]] = 1.0 / np.sqrt(max(len(places[k]), 1))
            total += block @ matrix
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, x in enumerate(texts) if has_letter(x)] if self.languages else []
        for b in range(0, len(at), BLOCK):
            rows = at[b : b + BLOCK]
            s = self.scores([texts[i] for i in rows]).astype(np.float64)
            e = np.exp(4.0 * (s - s.max(axis=1, keepdims=True)))
            for i, k, p in zip(rows, s.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1), strict=True):
                names[i], sure[i] = self.languages[k], float(p)
        return names, sure


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Every ``n/landmarks``-th text, languages in turn, is a landmark."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], [], np.zeros(0))
    return fit_presence([presence(x) for x in texts], labels, landmarks, ridge)


def fit_presence(held: list[list[np.ndarray]], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], [], np.zeros(0))
    turn: dict[str, int] = {}
    order = []
    for i, x in enumerate(labels):
        order.append((turn.setdefault(x, 0), i))
        turn[x] += 1
    marks = [i for _, i in sorted(order)[:landmarks]]

    def dense(rows: list[int], k: int, size: int) -> np.ndarray:
        out = np.zeros((len(rows), size), np.float32)
        for r, i in enumerate(rows):
            out[r, held[i][k]] = 1.0 / np.sqrt(max(len(held[i][k]), 1))
        return out

    bases = [dense(marks, k, size) / len(PLACES) for k, size in enumerate(PLACES.values())]
    kernel = np.vstack([sum(dense(list(range(b, min(b + BLOCK, len(held)))), k, size) @ bases[k].T for k, size in enumerate(PLACES.values())) for b in range(0, len(held), BLOCK)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[marks])
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.array([[1.0 if x == y else -1.0 for y in languages] for x in labels])
    weight = np.array([1.0 / turn[x] for x in labels])
    weight *= len(labels) / weight.sum()
    mean_f, mean_t = (features * weight[:, None]).mean(axis=0), (target * weight[:, None]).mean(axis=0)
    f, t = features - mean_f, target - mean_t
    solved = np.linalg.solve(f.T @ (f * weight[:, None]) + ridge * len(labels) * np.eye(f.shape[1]) / 100, f.T @ (t * weight[:, None]))
    return Model(languages, [(b.T @ (root @ solved)).astype(np.float32) for b in bases], mean_t - mean_f @ solved)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows, at most ``per_language`` of each language, chosen by a hash of the id.

    An id that repeats counts once: with its smallest label, and of the rows with
    that and a letter the one with the smallest text hash.

    Only places of n-grams reach the driver, so the sample is bounded in bytes
    too, however long its texts are.
    """
    doc_id = F.col(id_col)
    labelled = docs.select(doc_id.alias("doc_id"), F.col(label_col).alias("label")).where(doc_id.isNotNull() & F.col("label").isNotNull() & ~held_out(doc_id))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # the first rows of a language are among the first of its parts, however the rows are dealt to these
    chosen = (
        labelled.groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(RANK_PARTS)))
        .withColumn("turn", F.row_number().over(Window.partitionBy("label", "part").orderBy(*order)))
        .where(F.col("turn") <= per_language)
        .withColumn("turn", F.row_number().over(Window.partitionBy("label").orderBy(*order)))
        .where(F.col("turn") <= per_language)
        .orderBy("turn", "label")
        .limit(rows)
        .select("doc_id", "label", "turn")
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            held = [presence(x) if has_letter(x) else None for x in part.column(4).to_pylist()]
            packed = [None if h is None else b"".join(np.packbits(np.bincount(p, minlength=s).astype(bool)).tobytes() for p, s in zip(h, PLACES.values(), strict=True)) for h in held]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(packed, pa.binary())], names=["doc_id", "label", "turn", "hash", "packed"])

    texts = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("label is not null")
    # at most ``rows`` ids: a size that is known
    found = small_batches(texts).join(F.broadcast(chosen), ["doc_id", "label"]).select("doc_id", "label", "turn", F.xxhash64("text").alias("hash"), "text")
    kinds = [f"{x} {found.schema[x].dataType.simpleString()}" for x in ("doc_id", "label", "turn", "hash")]
    # one row of an id that repeats
    sample = found.mapInArrow(run, ", ".join([*kinds, "packed binary"])).where("packed is not null").groupBy("doc_id", "label", "turn").agg(F.min_by("packed", "hash").alias("packed"))
    got = sorted((r["turn"], r["label"], bytes(r["packed"])) for r in sample.collect())
    held = []
    for _, _, packed in got:
        bits, at, places = np.unpackbits(np.frombuffer(packed, np.uint8)), 0, []
        for size in PLACES.values():
            places.append(np.flatnonzero(bits[at : at + size]))
            at += size
        held.append(places)
    return fit_presence(held, [x for _, x, _ in got])


def predict_languages(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            names, sure = shared.value.predict(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return small_batches(source).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows whose language is known, with all their columns as they were.

    A model without languages rejects only what has no letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            texts = part.column(at).to_pylist()
            known = [x != UNKNOWN for x in shared.value.predict(texts)[0]] if shared.value.languages else [has_letter(x) for x in texts]
            yield part.filter(pa.array(known, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
