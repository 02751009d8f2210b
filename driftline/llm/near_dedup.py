"""MinHash near-dedup by an LSH forest, links confirmed on full shingle sets.

Every text's set of word shingles gives TREES x DEPTH minimum hashes. Texts with
equal sets are one node from then on. In each tree, nodes are sorted by the
tree's DEPTH hashes; those that share the first TOP of them form a region. Links
are found in three passes, each looking only at nodes that are still in
different components:

1. each node against one other, the smallest of its regions' first nodes;
2. each node against its neighbours in the sorted orders and the first nodes of
   all its regions. In a region of more than DENSE nodes the depth adapts: it is
   cut by all DEPTH hashes, each part has a first node of its own, and parts that
   are still too large are dealt out by a hash;
3. what is then still apart in a region in full: the region's nodes are dealt
   into blocks of bounded size, and every two blocks whose sizes allow the
   threshold give the exact similarity of all their pairs between two components.

In the first two passes, candidates whose sketches are too far apart to reach
the threshold by many standard deviations fall away, and the rest is confirmed
on the full sets. They only save work: the third pass decides every pair that
shares a region. It takes time with the square of a region in which hardly any
two nodes are linked, and no more rows at once than two blocks.

Two sets at the threshold of 0.85 share the first 4 hashes in at least one of
16 trees with probability 1 - (1 - 0.85^4)^16 = 0.99999.

Defined cases: a text without words has an empty set, is linked with nothing
and kept; one with fewer words than a shingle is its whole sequence; repeated
rows are copies; a null id never is a component's smallest unless all are null;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import bitmap, marked, materialize, slices, small_batches, words_of
from driftline.llm.hashing import WordHashes, mix, shingles

TREES, DEPTH, TOP = 16, 8, 4
#: Nodes of a region from which the depth adapts, and neighbours before a node; the third pass needs neither.
DENSE, NEIGHBOURS = 64, 2
#: Nodes and shingles of a block, about; shared shingles counted at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 18, 2048

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minimum hashes (32 bits each) of a set that isn't empty."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max)
    for b in range(0, len(s), 2048):
        low = np.minimum(low, ((s[b : b + 2048, None] ^ _B) * _A).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def describe(docs: DataFrame, *, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null for an empty set), signature, sketch of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in slices(parts):
            held = [shingles(words.of(words_of(x)), n) for x in part.column(2).to_pylist()]
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in held]
            signs = [signature(s) if len(s) else None for s in held]
            columns = [
                part.column(0),
                part.column(1),
                pa.array([len(s) for s in held], pa.int64()),
                pa.array(nodes, pa.binary()),
                pa.array([None if s is None else s.tobytes() for s in signs], pa.binary()),
                pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in signs], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "node", "signature", "sketch"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return small_batches(source).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node binary, signature binary, sketch binary")


def forest(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree: region, deep (a hash of all the tree's hashes), order (its sort key), node."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            if not part.num_rows:
                continue
            s = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, TREES, DEPTH).astype(np.uint64)
            region = np.broadcast_to(mix(np.arange(TREES, dtype=np.uint64) + np.uint64(77)), s.shape[:2]).copy()
            for k in range(TOP):
                region = mix(region + s[:, :, k])
            deep = region.copy()
            for k in range(TOP, DEPTH):
                deep = mix(deep + s[:, :, k])
            order = (s[:, :, TOP] << np.uint64(32)) | s[:, :, TOP + 1]
            node = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), TREES)))
            flat = lambda x: pa.array(x.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([flat(region), flat(deep), flat(order), node], names=["region", "deep", "order", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "region long, deep long, order long, node binary")


def regions(nodes: DataFrame) -> DataFrame:
    """Members (region, deep, order, node, n, hub) of the regions of several nodes; hub is the smallest of them."""
    rows = forest(nodes)
    shared = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").withColumnRenamed("region", "of")
    # written first: a join of two plain shuffles can be split where a region is hot
    return materialize(rows.join(materialize(shared, "regions"), F.col("region") == F.col("of")).drop("of"), "forest")


def with_labels(rows: DataFrame, labels: DataFrame, name: str, label: str) -> DataFrame:
    """Adds ``label`` of the node in column ``name``: its own name where it has no links yet."""
    joined = rows.join(labels.toDF("at_", "label_"), F.col(name) == F.col("at_"), "left")
    return joined.withColumn(label, F.coalesce("label_", name)).drop("at_", "label_")


def neighbours(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs a < b of different components: neighbours in the sorted orders, and first nodes of regions and their parts."""
    named = materialize(with_labels(members, labels, "node", "label"), "named")
    open_ = materialize(open_regions(named), "regions")
    named = named.join(open_, F.col("region") == F.col("of")).drop("of")
    dense = named.where(F.col("n") > DENSE)
    parts = dense.groupBy(F.col("region").alias("of"), F.col("deep").alias("cut")).agg(F.count("*").alias("held"), F.min(F.struct("node", "label")).alias("first"))
    dense = materialize(dense.join(parts, (F.col("region") == F.col("of")) & (F.col("deep") == F.col("cut"))), "dense")
    dealt = F.xxhash64("deep", F.pmod(F.hash("node"), F.ceil(F.col("held") / F.lit(float(DENSE)))))
    placed = named.where(F.col("n") <= DENSE).select("region", F.lit(0).cast("long").alias("part"), "deep", "order", "node", "label")
    placed = placed.unionByName(dense.select("region", dealt.alias("part"), "deep", "order", "node", "label"))
    sorted_in = Window.partitionBy("region", "part").orderBy("order", "deep", "node")
    before = F.array(*[F.lag(F.struct("node", "label"), i).over(sorted_in) for i in range(1, NEIGHBOURS + 1)])
    near = placed.withColumn("before", before).select("node", "label", F.explode("before").alias("first"))
    near = near.unionByName(dense.select("node", "label", "first")).where(F.col("first").isNotNull() & (F.col("label") != F.col("first.label"))).select("node", F.col("first.node").alias("first"))
    hubs = with_labels(named.select("node", "label", "hub").distinct(), labels, "hub", "first_label").where("label != first_label").select("node", F.col("hub").alias("first"))
    return ordered(near.unionByName(hubs))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()


def open_regions(named: DataFrame) -> DataFrame:
    """of: the regions whose nodes (region, label) are in several components."""
    return named.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select(F.col("region").alias("of"))


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sketches may belong to sets at the threshold (6 deviations below)."""
    k = TREES * DEPTH
    least = threshold - 6.0 * (threshold * (1.0 - threshold) / k) ** 0.5
    sketches = nodes.select("node", "sketch")
    joined = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            if not part.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in (2, 3))
            good = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    return joined.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a binary, b binary")


def full_sets(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, n: int) -> DataFrame:
    """node, shingles (the sorted set as bytes) of the nodes in ``wanted`` (node, doc_id)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in slices(parts):
            held = [shingles(words.of(words_of(x)), n).tobytes() for x in part.column(1).to_pylist()]
            nodes = [xxhash.xxh3_128_digest(s) for s in held]
            good = [x == y for x, y in zip(nodes, part.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(held, pa.binary())], names=["node", "shingles"]).filter(pa.array(good, pa.bool_()))

    texts = docs.select(F.col(id_col).cast("long").alias("of"), F.col(text_col).alias("text"))
    # most texts have no candidate: a bitmap keeps them out of the shuffle
    texts = marked(texts, bitmap(wanted, "doc_id"), "of").where("maybe")
    found = texts.join(wanted, F.col("of").eqNullSafe(F.col("doc_id"))).select("node", "text").mapInArrow(run, "node binary, shingles binary")
    return found.dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            good = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of all nodes in links (a, b).

    Labels fall to the smallest of the neighbours' and then to that label's
    own label, so chains shorten by half and more with each round.
    """
    links = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = materialize(labels, "labels")
    while True:
        seen = links.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        hop = lower.join(labels.toDF("at", "beyond"), F.col("next") == F.col("at"), "left")
        moved = materialize(hop.select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), (F.least("next", F.coalesce("beyond", "next")) < F.col("label")).alias("fell")), "labels")
        if moved.where("fell").isEmpty():
            return labels
        labels = moved.select("node", "label")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row."""
    slim = materialize(describe(docs, id_col=id_col, text_col=text_col, n=n), "described")
    whole = slim.where("node is not null")
    nodes = materialize(whole.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")), "nodes")
    members = regions(nodes)
    labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    if not members.isEmpty():
        listed = materialize(members.select("node").distinct().join(nodes.select("node", "doc_id"), "node"), "listed")
        sets = materialize(full_sets(docs, listed, id_col=id_col, text_col=text_col, n=n), "sets")
        linked = lambda pairs: materialize(confirmed(likely(pairs, nodes, percent / 100.0), sets, percent), "links")
        first = members.where("node != hub").groupBy("node").agg(F.min("hub").alias("first"))
        labels = merged(linked(ordered(first)), labels)
        labels = merged(linked(neighbours(members, labels)), labels)
        labels = merged(materialize(left_over(members, labels, sets, percent), "links"), labels)
    mapped = nodes.select("node", "doc_id").join(labels.toDF("at", "label"), F.col("node") == F.col("at"), "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = mapped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = mapped.join(smallest, "label").select(F.col("node").alias("at"), "component_id")
    out = slim.select("doc_id", "text_hash", "n_shingles", "node").join(of_node, F.col("node") == F.col("at"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def similar(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for each set of x and of y."""
    n = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
    flat = [np.concatenate(side) for side in (x, y)]
    shared = np.intersect1d(*flat)
    common = np.zeros((len(x), len(y)), np.float32)
    rows, places = [], []
    for side, sizes in zip(flat, n, strict=True):
        place = np.minimum(np.searchsorted(shared, side), max(len(shared) - 1, 0))
        held = np.flatnonzero(shared[place] == side) if len(shared) else np.zeros(0, np.int64)
        order = held[np.argsort(place[held], kind="stable")]
        rows.append(np.repeat(np.arange(len(sizes)), sizes)[order])
        places.append(place[order])
    for first in range(0, len(shared), COLUMNS):
        held = []
        for row, place, sizes in zip(rows, places, n, strict=True):
            part = slice(*np.searchsorted(place, [first, first + COLUMNS]))
            matrix = np.zeros((len(sizes), min(COLUMNS, len(shared) - first)), np.float32)
            matrix[row[part], place[part] - first] = 1.0
            held.append(matrix)
        common += held[0] @ held[1].T
    common = common.astype(np.int64)
    return 100 * common >= percent * (n[0][:, None] + n[1][None, :] - common)


def left_over(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a region, at least one for every two components that have any.

    Sizes of sets at the threshold are in one bucket or in neighbouring ones.
    Blocks are dealt by a hash within a region and bucket; a component with a
    block's worth of nodes there has its own, which needn't meet one another.
    """
    named = materialize(with_labels(members.select("region", "node"), labels, "node", "label"), "named")
    open_ = materialize(open_regions(named), "regions")
    width = 1.001 * float(np.log(100.0 / percent))
    sizes = sets.select(F.col("node").alias("at"), F.expr("length(shingles) div 8").alias("size"))
    sized = named.join(open_, F.col("region") == F.col("of")).join(sizes, F.col("node") == F.col("at")).select("region", "node", "label", "size", F.floor(F.log("size") / F.lit(width)).alias("bucket"))
    sized = materialize(sized, "open")
    of_label = sized.groupBy("region", "bucket", "label").agg(F.count("*").alias("held"))
    large = of_label.where(F.col("held") >= BLOCK).select("region", "bucket", "label", F.col("label").alias("own"))
    placed = sized.join(large, ["region", "bucket", "label"], "left")
    slots = F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("size") / F.lit(float(BLOCK_SHINGLES))))
    groups = placed.groupBy("region", "bucket", "own").agg(slots.alias("slots"))
    same = (F.col("p.region") == F.col("g.region")) & (F.col("p.bucket") == F.col("g.bucket")) & F.col("p.own").eqNullSafe(F.col("g.own"))
    dealt = placed.alias("p").join(groups.alias("g"), same).select("p.region", "p.bucket", "p.own", "node", "label", F.pmod(F.xxhash64("node"), F.col("slots")).alias("slot"))
    dealt = materialize(dealt.withColumn("block", F.struct("bucket", "own", "slot")), "dealt")
    blocks = dealt.groupBy("region", "bucket", "own", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left, right = blocks.alias("x"), blocks.alias("y")
    meet = (F.col("x.region") == F.col("y.region")) & (F.col("x.block") <= F.col("y.block")) & (F.col("y.bucket") - F.col("x.bucket") <= 1)
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    pairs = left.join(right, meet & apart).select("x.region", F.col("x.block").alias("one"), F.col("y.block").alias("other"))
    pairs = materialize(pairs.withColumn("pair", F.xxhash64("region", "one", "other")), "blocks")
    sides = pairs.select("region", "pair", F.col("one").alias("block"), F.lit(False).alias("second")).unionByName(pairs.where("one != other").select("region", "pair", F.col("other").alias("block"), F.lit(True).alias("second")))
    rows = sides.join(dealt.select("region", "block", "node", "label"), ["region", "block"]).join(sets, "node").select("region", "pair", "second", "node", "label", "shingles")

    def run(part: pa.Table) -> pa.Table:
        nodes, names = part.column("node").to_pylist(), part.column("label").to_pylist()
        held = [np.frombuffer(s, np.uint64) for s in part.column("shingles").to_pylist()]
        second = np.array(part.column("second").to_pylist(), bool)
        x = np.flatnonzero(~second)
        y = np.flatnonzero(second) if second.any() else x
        number = {name: i for i, name in enumerate(dict.fromkeys(names))}
        label = np.array([number[name] for name in names])
        good = similar([held[i] for i in x], [held[i] for i in y], percent) & (label[x][:, None] != label[y][None, :])
        i, j = np.nonzero(good)
        # one link is enough for two components
        _, once = np.unique(np.sort(np.stack([label[x[i]], label[y[j]]], axis=1), axis=1), axis=0, return_index=True)
        ends = [(nodes[x[i[k]]], nodes[y[j[k]]]) for k in once]
        return pa.table({"a": pa.array([min(e) for e in ends], pa.binary()), "b": pa.array([max(e) for e in ends], pa.binary())})

    return rows.groupBy("region", "pair").applyInArrow(run, "a binary, b binary").distinct()


def merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, label) after further links (a, b) between components."""
    if links.isEmpty():
        return labels
    if labels.isEmpty():
        return components(links)
    lifted = with_labels(with_labels(links, labels, "a", "x"), labels, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    over = components(lifted)
    before = labels.unionByName(over.select("node", F.col("node").alias("label")).join(labels.select(F.col("node").alias("at")), F.col("node") == F.col("at"), "left_anti"))
    after = before.join(over.toDF("from", "to"), F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(after, "labels")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 85) -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns.

    Rows without words stay; of repeated rows one stays.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, n=n, percent=percent)
    rows = found.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    # rows to drop or to look at again; all others pass without a shuffle
    doubtful = materialize(rows.where("n > 1 or not kept"), "doubtful")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    packed = marked(packed, bitmap(doubtful, "of_id", "of_hash"), "doc_id", "text_hash")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    once = Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0))
    looked_at = packed.where("maybe").join(doubtful, same, "left").where(F.coalesce("kept", F.lit(True))).withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return packed.where("not maybe").select("row").unionByName(looked_at.select("row")).select("row.*")
