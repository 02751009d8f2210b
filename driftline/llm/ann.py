"""Approximate nearest neighbours by additive quantisation.

Vectors are brought to length one and written as sums of codewords, one from
each of several full-dimensional codebooks. The codebooks are fitted one after
the other to what the earlier ones leave (k-means on a bounded sample), and a
vector is encoded by beam search: the best partial sums are kept at every
codebook, not just the one that looks best. The norm of the sum is stored with
the codes. A query makes one table of its products with all codewords; a
candidate's score is the sum of its codes' entries over its stored norm.

The codes are dealt into slices of SLICE_ROWS rows, or fewer where there are few
rows, and stay there: a task holds one slice, and all queries pass it in packed
blocks. So a row's codes are shuffled once, and a query's vector once for each
slice. The best ``rerank`` of each query over all slices are scored exactly on
the original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than most, as a cosine
needs equal lengths; rows of one id are one candidate and one query, with the
vector whose hash is smallest; ties go to the smaller id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import bitmap, marked, materialize

#: Codebooks, codewords in each, partial sums kept while encoding.
BOOKS, WORDS, BEAM = 32, 256, 4
#: Vectors that the codebooks are fitted to, at most, and rounds of k-means.
SAMPLE, ROUNDS = 8192, 6
#: Rows encoded and queries scored at once, and candidates of a query that are scored exactly.
ROW_BLOCK, QUERY_BLOCK, RERANK = 2048, 64, 100
#: Rows of a slice, about, and the least number of slices.
SLICE_ROWS, SLICES = 1 << 20, 12


@dataclass
class Books:
    words: np.ndarray  # books x words x dimensions

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x books, uint8) and norms of the sums, by beam search."""
        rows = np.arange(len(x))[:, None]
        left, codes = x[:, None, :], np.zeros((len(x), 1, 0), np.uint8)
        error = np.einsum("rbd,rbd->rb", left, left)
        for book in self.words:
            # |left - word|^2 = |left|^2 - 2 left.word + |word|^2
            cost = error[:, :, None] - 2.0 * (left @ book.T) + np.einsum("wd,wd->w", book, book)
            flat = cost.reshape(len(x), -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            order = np.take_along_axis(flat, best, 1).argsort(axis=1, kind="stable")
            best = np.take_along_axis(best, order, 1)
            parent, word = best // len(book), best % len(book)
            left = left[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
            error = np.take_along_axis(flat, best, 1)
        return codes[:, 0], np.linalg.norm(x - left[:, 0], axis=1).astype(np.float32)


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> Books:
    rng, left, out = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        centres = left[rng.permutation(len(left))[: min(words, len(left))]].copy()
        for _ in range(rounds):
            near = (-2.0 * left @ centres.T + np.einsum("wd,wd->w", centres, centres)).argmin(axis=1)
            count = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, left)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        near = (-2.0 * left @ centres.T + np.einsum("wd,wd->w", centres, centres)).argmin(axis=1)
        left = left - centres[near]
        out.append(np.vstack([centres, np.zeros((words - len(centres), x.shape[1]), np.float32)]))
    return Books(np.array(out, np.float32))


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, components in order."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(values: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def best_rows(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of each row's ``most`` largest, ties at the edge to smaller ids; ids ascend along a row."""
    n = scores.shape[1]
    if n > most:
        least = np.partition(scores, n - most, axis=1)[:, n - most]
        keep = scores > least[:, None]
        level = scores == least[:, None]
        keep |= level & (np.cumsum(level, axis=1) <= (most - keep.sum(axis=1))[:, None])
        at = np.nonzero(keep)[1].reshape(len(scores), most)
        return np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    return ids, scores


def scored(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Queries x rows: the sum of each row's entries in each query's table, over the row's norm."""
    total = np.take(tables[:, 0], codes[0], axis=1)
    for b in range(1, len(codes)):
        total += np.take(tables[:, b], codes[b], axis=1)
    return total / norms


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest other rows of each query row."""
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("q")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["n"]
    good = good.where(F.size("v") == dim)
    # rows of one id: one of them
    again = materialize(good.groupBy("vec_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("v")).alias("least")).where("n > 1").select(F.col("vec_id").alias("of"), "least"), "repeated-ids")
    if not again.isEmpty():
        some = marked(good, bitmap(again, "of"), "vec_id")
        joined = some.where("maybe").join(again, F.col("vec_id") == F.col("of"), "left").where(F.col("of").isNull() | (F.xxhash64("v") == F.col("least")))
        good = materialize(some.where("not maybe").select("vec_id", "v", "q").unionByName(joined.groupBy("vec_id").agg(F.first("v").alias("v"), F.max("q").alias("q"))), "vectors")
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).toArrow()
    books = spark.sparkContext.broadcast(fit_books(unit(drawn.column(0).combine_chunks(), dim)))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in range(0, part.num_rows, ROW_BLOCK):
                p = part.slice(b, ROW_BLOCK)
                order = np.argsort(p.column(0).to_numpy(), kind="stable")
                ids, x = p.column(0).to_numpy()[order], unit(p.column(1), dim)[order]
                codes, norms = books.value.encode(x)
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()]), pa.array([codes.tobytes()]), pa.array([norms.astype("<f4").tobytes()])], names=["ids", "codes", "norms"])

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in range(0, part.num_rows, QUERY_BLOCK):
                p = part.slice(b, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([p.column(0).to_numpy().astype("<i8").tobytes()]), pa.array([unit(p.column(1), dim).tobytes()])], names=["q_ids", "q_x"])

    index = good.select("vec_id", "v").mapInArrow(encode, "ids binary, codes binary, norms binary")
    asked = materialize(good.where("q").select("vec_id", "v"), "queries")
    n_slices = max(SLICES, -(-good.count() // SLICE_ROWS))
    # few packed rows: batches of any number of queries, so they are brought together first
    blocks = asked.coalesce(max(1, asked.count() // (64 * QUERY_BLOCK))).mapInArrow(pack, "q_ids binary, q_x binary")

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = books.value.words
        at, held, ready = None, [], None
        for part in parts:
            for r in part.to_pylist():
                if r["slice"] != at:
                    at, held, ready = r["slice"], [], None
                if r["q_ids"] is None:  # a slice's rows come first
                    held.append((r["ids"], r["codes"], r["norms"]))
                    continue
                if not held:
                    continue
                if ready is None:
                    ids = np.concatenate([np.frombuffer(x, "<i8") for x, _, _ in held])
                    order = np.argsort(ids, kind="stable")
                    codes = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, len(words)) for _, x, _ in held])[order]
                    norms = np.concatenate([np.frombuffer(x, "<f4") for _, _, x in held])[order]
                    ready = ids[order], np.ascontiguousarray(codes.T), np.maximum(norms, 1e-6)
                ids, codes, norms = ready
                asking = np.frombuffer(r["q_ids"], "<i8")
                tables = np.einsum("qd,bwd->qbw", np.frombuffer(r["q_x"], np.float32).reshape(len(asking), dim), words, optimize=True)
                best_ids, best = np.zeros((len(asking), 0), np.int64), np.zeros((len(asking), 0), np.float32)
                for b in range(0, len(ids), ROW_BLOCK):
                    own = slice(b, b + ROW_BLOCK)
                    s = scored(tables, codes[:, own], norms[own])
                    s[asking[:, None] == ids[None, own]] = -np.inf
                    every = np.broadcast_to(ids[own], s.shape)
                    best_ids, best = best_rows(np.concatenate([best, s], axis=1), np.concatenate([best_ids, every], axis=1), rerank)
                good = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asking, good.sum(axis=1))), pa.array(best_ids[good]), pa.array(best[good])], names=["query_id", "vec_id", "approx"])

    none = F.lit(None).cast("binary")
    rows = index.select(F.pmod(F.xxhash64("ids"), F.lit(n_slices)).cast("int").alias("slice"), "ids", "codes", "norms", none.alias("q_ids"), none.alias("q_x"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))
    queries = blocks.select(every.alias("slice"), none.alias("ids"), none.alias("codes"), none.alias("norms"), "q_ids", "q_x")
    met = rows.unionByName(queries).repartition(n_slices, "slice").sortWithinPartitions("slice", F.col("q_ids").isNotNull())
    near = met.mapInArrow(score, "query_id long, vec_id long, approx float")
    by_approx = Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id")
    near = near.withColumn("at", F.row_number().over(by_approx)).where(F.col("at") <= rerank).select("query_id", "vec_id")
    own = good.select("vec_id", "v")
    exact = near.join(own, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    exact = exact.select("query_id", "vec_id", cosine(F.col("v"), F.col("qv")).alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
