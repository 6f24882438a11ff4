"""Near-duplicate classes by min-max hashing with exact confirmation.

Both the smallest and the largest image under each permutation are kept, so ``bands * rows / 2`` permutations give
``bands * rows`` signature values. Equal shingle sets become one node first. Nodes that share a band are candidates;
bands and rows are set so that a pair at the threshold is missed with a probability below 1e-8.

Candidates are confirmed on full sets in two steps. First each node is compared with one hub only (the node it
shares most bands with among the most popular of its buckets), and linked nodes are joined. What is left are bucket
members of different classes: those are compared in blocks of bounded size inside the tasks, which send on only
the pairs that pass, so a large bucket of texts that are alike but not linked yields no rows. Classes are then
closed by contracting edges until none joins two classes.

Defined cases: texts without words and null texts have no shingles and link with nothing; repeated rows and equal
texts share a class; rows that repeat a doc id with other texts are compared on their own; null ids are never
the smallest, and kept only where no row of the class has another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm.common import ROW, bounded, discard, merged, runs, stored, table
from cellarmark.llm.shingles import FACTOR, mixed, shingle_sets
from cellarmark.session import cut_lineage

SEED = 20_240_607
BLOCK = 512
"""Members of one bucket that a task compares with as many others."""
SIGNATURES = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"
PERMUTED_AT_ONCE = 2048
TOKENS_AT_ONCE = 2048


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, alternating."""
    low, high = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(factors), np.uint64)
    for at in range(0, len(shingles), PERMUTED_AT_ONCE):
        images = factors[:, None] * shingles[None, at : at + PERMUTED_AT_ONCE] + shifts[:, None]
        np.minimum(low, images.min(axis=1), out=low)
        np.maximum(high, images.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, size and 128-bit key of the shingle set, band keys (null without shingles), row number if ``docs`` has one."""
    carried = [ROW] if ROW in docs.columns else []

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = permutations(bands * rows // 2)
        for batch in batches:
            sizes, keys, values = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                sizes.append(len(s))
                keys.append((int(s.sum(dtype=np.uint64)), int(mixed(s ^ FACTOR).sum(dtype=np.uint64))))
                if len(s):
                    values.append(signature(s, factors, shifts))
            parts = np.array(values, np.uint64).reshape(-1, bands, rows)
            folded = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
            for r in range(rows):
                folded = mixed(folded * FACTOR + parts[:, :, r])
            full = np.array(sizes, np.int64) > 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32), mask=np.append(~full, False))
            pairs = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "key_a": pa.array(pairs[:, 0]),
                    "key_b": pa.array(pairs[:, 1]),
                    "bands": pa.ListArray.from_arrays(offsets, pa.array(folded.ravel().view(np.int64))),
                }
                | {c: batch.column(c) for c in carried}
            )

    return bounded(docs).select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(sign, ", ".join([SIGNATURES, *(f"{c} long" for c in carried)]))


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, shingle set (64-bit little-endian, sorted), the set cut to 32 bits, of the wanted nodes (node, doc_id, key_a, key_b)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("key_a").to_pylist(), batch.column("key_b").to_pylist(), strict=True)
            nodes, sets, short = [], [], []
            for node, key, s in zip(batch.column("node").to_pylist(), keys, shingle_sets(batch.column("text"), width), strict=True):
                own = np.array([s.sum(dtype=np.uint64), mixed(s ^ FACTOR).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                if (int(own[0]), int(own[1])) == key:  # another row may carry the same doc id
                    nodes.append(node)
                    sets.append(s.tobytes())
                    short.append(np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "shingles": pa.array(sets, pa.binary()), "short": pa.array(short, pa.binary())})

    by = ROW if ROW in docs.columns else "doc_id"
    named = docs.select(F.col(by).cast("long").alias("_doc"), "text")
    texts = named.join(wanted, F.col("_doc").eqNullSafe(F.col(by))).select("node", "key_a", "key_b", "text")
    return texts.mapInArrow(compute, "node long, shingles binary, short binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            passed = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                passed.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(passed, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return merged(merged(pairs.select("a", "b"), left, "a"), right, "b").mapInArrow(check, "a long, b long")


def similar_in_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs that join the classes of a block, among those that may pass ``percent``.

    ``blocks``: block, side, node, class, n and ``short`` (the set cut to 32 bits), grouped by block. Members of side 0
    and 1 are compared with each other, in a block of one side (0 only) all are. Cutting may change a common count a
    little, so pairs within two of the threshold are all sent on to be confirmed.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "block"):
            side, label = group.column("side").to_numpy(), group.column("class").to_numpy()
            n, nodes = group.column("n").to_numpy(), group.column("node").to_numpy()
            sets = [np.frombuffer(x, "<u4") for x in group.column("short").to_pylist()]
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            column = np.cumsum(seen > 1) - 1
            shared = seen[token] > 1
            owner, token = owner[shared], column[token[shared]]
            common = np.zeros((len(sets), len(sets)), np.float32)
            order = np.argsort(token, kind="stable")
            owner, token = owner[order], token[order]
            for at in range(0, int(token[-1]) + 1 if len(token) else 0, TOKENS_AT_ONCE):
                lo, hi = np.searchsorted(token, [at, at + TOKENS_AT_ONCE])
                dense = np.zeros((len(sets), TOKENS_AT_ONCE), np.float32)
                dense[owner[lo:hi], token[lo:hi] - at] = 1
                common += dense @ dense.T
            apart = label[:, None] != label[None, :]
            apart &= (side[:, None] < side[None, :]) if side.any() else np.triu(np.ones_like(apart), 1)
            total = n[:, None] + n[None, :]
            maybe = apart & (100 * (common + 2) >= percent * (total - common - 2))
            sure = maybe & (100 * (common - 2) >= percent * (total - common + 2))
            i, j = spanning(sure, maybe & ~sure, label)
            yield pa.record_batch({"a": pa.array(nodes[i]), "b": pa.array(nodes[j])})

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long")


def spanning(sure: np.ndarray, maybe: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sure pairs a forest that joins the same classes; of the others all that it leaves apart."""
    root = {int(c): int(c) for c in label}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    kept = []
    for i, j in zip(*np.nonzero(sure), strict=True):
        a, b = find(int(label[i])), find(int(label[j]))
        if a != b:
            root[a] = b
            kept.append((i, j))
    kept += [(i, j) for i, j in zip(*np.nonzero(maybe), strict=True) if find(int(label[i])) != find(int(label[j]))]
    both = np.array(kept, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def classes_of(links: DataFrame) -> DataFrame:
    """node, class (smallest reachable node) for the nodes of ``links`` (a, b), by contracting edges."""
    edges = cut_lineage(links.select("a", "b").filter("a <> b").distinct())
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    labels = cut_lineage(ends.withColumn("class", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("least"))
        parent = parent.select("class", F.least("class", "least").alias("up"))
        above = parent.select(F.col("class").alias("up"), F.col("up").alias("top"))
        parent = cut_lineage(merged(parent, above, "up").select("class", F.coalesce("top", "up").alias("up")))
        labels = cut_lineage(merged(labels, parent, "class", "left").select("node", F.coalesce("up", "class").alias("class")))
        a = parent.select(F.col("class").alias("a"), F.col("up").alias("ua"))
        b = parent.select(F.col("class").alias("b"), F.col("up").alias("ub"))
        edges = cut_lineage(merged(merged(edges, a, "a"), b, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).filter("a <> b").distinct())
    return labels


def near_duplicates(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc id of the class), kept for every row of ``docs`` (doc_id, text).

    If ``docs`` has row numbers in ``ROW``, they and the class (null without shingles) are returned too.
    """
    carried = [ROW] if ROW in docs.columns else []
    signed = stored(signatures(docs, width, bands, rows), "minmax-signatures")
    key = ["n_shingles", "key_a", "key_b"]
    nodes = signed.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), *(F.min(c).alias(c) for c in carried))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "minmax-nodes")

    entries = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    entries = stored(merged(entries, shared, "bucket"), "minmax-buckets")
    popular = entries.groupBy("node").agg(F.sum("members").alias("popularity"))
    hubs = merged(entries, popular, "node").groupBy("bucket").agg(F.max_by("node", F.struct("popularity", -F.col("node"))).alias("hub"), F.max_by("n", F.struct("popularity", -F.col("node"))).alias("hub_n"))
    wanted = merged(popular.select("node"), nodes.drop("bands", "n_shingles"), "node")
    sets = stored(full_sets(docs, wanted, width), "minmax-sets", "zstd")

    fitting = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    spokes = merged(entries, hubs, "bucket").filter((F.col("node") != F.col("hub")) & fitting).groupBy("node", "hub").agg(F.count("*").alias("together"))
    nearest = spokes.groupBy(F.col("node").alias("a")).agg(F.max_by("hub", F.struct("together", -F.col("hub"))).alias("b"))
    first_links = stored(confirmed(nearest, sets, percent), "minmax-links")
    first = classes_of(first_links)

    labelled = merged(entries, first, "node", "left").withColumn("class", F.coalesce("class", "node"))
    main = labelled.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed_buckets = merged(main.filter("low < high"), hubs.select("bucket", "hub"), "bucket")
    hub_class = first.select(F.col("node").alias("hub"), F.col("class").alias("hub_class"))
    mixed_buckets = merged(mixed_buckets, hub_class, "hub", "left").select("bucket", F.coalesce("hub_class", "hub").alias("main"))
    blocks = merged(in_blocks(merged(labelled, mixed_buckets, "bucket")), sets.select("node", "short"), "node")
    second_links = confirmed(similar_in_blocks(blocks, percent).distinct(), sets, percent)

    classes = classes_of(first_links.union(second_links))
    discard(entries, sets, first_links)
    ids = merged(nodes, classes, "node", "left").select(*key, "doc_id", F.coalesce("class", "node").alias("class"))
    smallest = ids.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    known = merged(ids, smallest, "class").select(*key, "component_id", "class")
    placed = merged(signed.select("doc_id", *carried, *key), known, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select(*carried, *(["class"] if carried else []), "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def in_blocks(members: DataFrame) -> DataFrame:
    """Deal bucket members to blocks. A small bucket is one block; in a large one the chunks outside the main class
    (the hub's) meet each other and all main chunks, which do not meet among themselves."""
    chunks = F.ceil(F.col("members") / BLOCK).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    in_main = F.col("class") == F.col("main")
    own = F.when(in_main, chunks + chunk).otherwise(chunk)
    others = F.when(in_main, F.sequence(F.lit(0), chunks - 1)).otherwise(F.sequence(F.lit(0), 2 * chunks - 1))
    met = F.transform(others, lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), (own > o).cast("int").alias("side")))
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    dealt = members.withColumn("met", F.explode(F.when(chunks == 1, single).otherwise(met)))
    return dealt.select(F.xxhash64("bucket", "met.i", "met.j").alias("block"), F.col("met.side").alias("side"), "node", "class", "n")


def op1_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85, bands=40, rows=6)
