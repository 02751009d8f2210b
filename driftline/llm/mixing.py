"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key scaled by its quality weight. A source
whose target holds whole epochs takes all its documents that many times; the
rest of its budget goes to the documents with the smallest keys, found by a
prefix sum of sizes in key order. Keys fall into as many buckets as the source
needs, so only the bucket in which the budget ends is ever sorted row by row.

Defined cases: a null text has size 0; a null source is a source of its own
and ranks last; repeated rows count as rows; rows with equal keys are ordered
by id, size and text hash; an empty table gives an empty result; columns that
are not named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, materialize

#: Rows of a source to a key bucket, on average.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_quality(text: Column) -> Column:
    """A quality weight from 0.5 (no letters) to 1.5 (letters only)."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.lit(0.5) + F.coalesce(letters / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def exponential_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight, with u in (0, 1) from the id alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(u) / weight


def plan_targets(
    sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """(source, source_size, n) -> the same with weight and target.

    Targets are in proportion to the weights, stop at ``max_epochs`` times the
    source's size, and pass what is over to the others by weight: min(cap,
    level x weight) with the one level at which all targets sum to the total.
    One row per source: the windows below run over sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("cap_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("cap_before", F.lit(0.0))) / F.col("weight_from"))
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    reached = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", "n", "weight", reached.alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    whole: bool = False,
    seed: str = "mix",
) -> DataFrame:
    """One row per input row: doc_id, text_hash, size, source, source_size, target, key, epochs, part, taken.

    ``epochs`` is how often the source is taken whole, ``part`` how many words
    come besides, ``taken`` all words that the mix takes, repeats counted. The
    document in which a budget ends gives just the words that are missing, or,
    with ``whole``, all or none, whichever is nearer.
    """
    text, size = F.col(text_col), F.col("size")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text).alias("text_hash"),
        word_count(text).alias("size"),
        exponential_key(F.col(id_col), letter_quality(text), seed).alias("key"),
    )
    slim = materialize(slim, "mix")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = (
        plan_targets(totals, weights, share, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
        .withColumn("buckets", F.ceil(F.col("n") / F.lit(float(BUCKET_ROWS))))
    )
    targets = materialize(targets, "mix-targets").withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    # 1 - exp(-key) grows with the key from 0 to 1, so buckets keep the order of keys
    placed = slim.join(targets, same).withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("buckets")).cast("long"))
    running = Window.partitionBy("source").orderBy("bucket")
    sums = placed.where("budget > 0").groupBy("source", "budget", "bucket").agg(F.sum("size").alias("held"))
    ends = (
        sums.withColumn("through", F.sum("held").over(running))
        .where("through > budget")
        .groupBy(F.col("source").alias("at"))
        .agg(F.min_by(F.struct("bucket", (F.col("through") - F.col("held")).alias("before")), "bucket").alias("end"))
        .select("at", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before"))
    )
    ends = materialize(targets.join(ends, F.col("of").eqNullSafe(F.col("at")), "left").drop("at"), "mix-ends")
    placed = slim.join(ends, same).withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("buckets")).cast("long"))
    inside = F.col("budget") > 0
    clear = placed.where(~inside | F.col("end_bucket").isNull() | (F.col("bucket") != F.col("end_bucket")))
    clear = clear.withColumn("part", F.when(inside & (F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket"))), size).otherwise(F.lit(0)))
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(in_order), F.lit(0))
    last = placed.where(inside & (F.col("bucket") == F.col("end_bucket"))).withColumn("left", left)
    part = F.when(F.col("left") * 2 >= size, size).otherwise(F.lit(0)) if whole else F.greatest(F.least(F.col("left"), size), F.lit(0))
    last = last.withColumn("part", part).drop("left")
    return clear.unionByName(last).select(
        "doc_id",
        "text_hash",
        "size",
        "source",
        "source_size",
        "target",
        "key",
        "epochs",
        F.col("part").cast("long").alias("part"),
        (F.col("epochs") * size + F.col("part")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The rows of the mix, whole documents, each as often as it is taken.

    A source's choice comes down to its epochs and the largest key taken beyond
    them, so documents meet one row for each source and are not shuffled by id.
    """
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, whole=True, **options)
    ends = mixed.groupBy("source").agg(F.max("epochs").alias("epochs_"), F.max(F.when(F.col("part") > 0, F.col("key"))).alias("last_")).withColumnRenamed("source", "source_")
    key = exponential_key(F.col(id_col), letter_quality(F.col(text_col)), seed)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), key.alias("key"))
    copies = F.col("epochs_") + F.coalesce(F.col("key") <= F.col("last_"), F.lit(False)).cast("long")
    placed = packed.join(materialize(ends, "mix-keys"), F.col("source").eqNullSafe(F.col("source_"))).select("row", copies.alias("copies")).where("copies > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
