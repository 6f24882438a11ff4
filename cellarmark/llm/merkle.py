"""Merkle manifest of a dataset by slot pivots: one subtree per source, one root over the subtrees.

A leaf is the digest of a row's fields. Per source the leaves ascend by doc_id and every ``fanout`` consecutive nodes
become one, until a single subroot is left; the subroots, ordered by source, are joined to the root in the same way.
A level is one aggregate: conditional maxima spread the children of each parent over ``fanout`` slot columns. The columns
laid end to end hash to the parent; all columns but a child's own are that child's siblings. Paths to the root are then
handed down the levels, each of which is a ``fanout``-th of the one below.

Positions come from range partitions and one short row per (partition, source), so a source that holds most rows is spread
over all tasks, and only single digests and level counts reach the driver.

Defined cases: null fields count as ``-``; rows that share a doc_id are ordered by leaf, equal rows follow each other (null
ids first); a null source is one of its own, the first; a source of one row has that leaf as its subroot, a table of one source
that subroot as its root; an empty table gives no rows and no root; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarmark.llm.common import stored, table

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTITION_BITS = 33
"""Row numbers of ``monotonically_increasing_id`` hold the partition above these bits."""


def field(value: Column) -> Column:
    """Length-prefixed bytes of a value, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest of a document row with ``text`` as its text."""
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else left as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


@dataclass
class Tree:
    """Levels from the leaves' parents upwards: tree, place, n (nodes of that level in the tree), digest and the slots."""

    nodes: DataFrame
    levels: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        """tree, digest of each tree's last node."""
        tops = self.nodes.filter("n = 1").select("tree", F.col("value.digest").alias("digest"))
        for level in self.levels:
            tops = tops.unionByName(level.filter("n = 1").select("tree", "digest"))
        return tops

    def paths(self, above: DataFrame) -> DataFrame:
        """tree, place, value and path of every leaf; ``above``: tree and the path from its root on."""
        known = None
        for level in reversed(self.levels):
            here = level.filter("n = 1").join(above, "tree")
            if known is not None:
                here = here.unionByName(level.filter("n > 1").join(known.drop("value"), ["tree", "place"]))
            known = here.select("tree", "place", "path", F.explode(self._children()).alias("child")).select(
                "tree",
                (F.col("place") * self.fanout + F.col("child.slot")).alias("place"),
                F.col("child.value").alias("value"),
                F.concat(F.array(F.struct(F.col("child.before").alias("before"), F.col("child.after").alias("after"))), "path").alias("path"),
            )
        single = self.nodes.filter("n = 1").join(above, "tree").select("tree", "place", "value", "path")
        return single if known is None else single.unionByName(known)

    def _children(self) -> Column:
        """Of the slots in use: number, value, digests before and after."""
        digests = [F.coalesce(F.col(f"s{s}.digest"), F.lit("")) for s in range(self.fanout)]
        joined = lambda some: F.concat(*some) if some else F.lit("")
        slots = [F.struct(F.lit(s).alias("slot"), F.col(f"s{s}").alias("value"), joined(digests[:s]).alias("before"), joined(digests[s + 1 :]).alias("after")) for s in range(self.fanout)]
        return F.filter(F.array(*slots), lambda c: c["value"].isNotNull())


def grown(nodes: DataFrame, most: int, label: str, fanout: int) -> Tree:
    """The levels over ``nodes`` (tree, place, n, value: a struct with the digest) of trees of up to ``most``; each is stored once."""
    levels, below = [], nodes
    while most > 1:
        slot = F.pmod("place", F.lit(fanout))
        spread = [F.max(F.when(slot == s, F.col("value"))).alias(f"s{s}") for s in range(fanout)]
        parents = below.filter("n > 1").groupBy("tree", F.floor(F.col("place") / fanout).alias("place")).agg(F.max("n").alias("n"), *spread)
        digest = F.sha2(F.concat(*[F.coalesce(F.col(f"s{s}.digest"), F.lit("")) for s in range(fanout)]), 256)
        levels.append(stored(parents.withColumn("n", F.ceil(F.col("n") / fanout)).withColumn("digest", digest), f"{label}-{len(levels) + 1}", "zstd"))
        below = levels[-1].select("tree", "place", "n", F.struct("digest").alias("value"))
        most = -(-most // fanout)
    return Tree(nodes, levels, fanout)


def placed(rows: DataFrame, group: list[str], order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with part and place (0, 1, ... by ``order`` within ``group``), and part, ``group``, shift, here of each run.

    A run is what one range partition holds of a group: at most as many rows as there are partitions and groups.
    """
    by = [*group, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, label, "zstd").withColumn("part", F.shiftright("at", PARTITION_BITS))
    runs = ranged.groupBy("part", *group).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    earlier = F.sum("here").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stored(runs.withColumn("shift", F.coalesce(earlier, F.lit(0)) - F.col("first")), f"{label}-runs")
    return ranged, runs


@dataclass
class Manifest:
    """Digests of a dataset: its sources (tree, src, n), the trees below and above the subroots, and the root (null without rows)."""

    sources: DataFrame
    below: Tree
    above: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """Carried columns, leaf, path (digests before and after the own one, level by level up to the root), subroot, root."""
        top = self.above.nodes.sparkSession.createDataFrame([(0,)], "tree long").withColumn("path", F.array().cast("array<struct<before:string,after:string>>"))
        of_source = self.above.paths(top).select(F.col("place").alias("tree"), F.col("value.digest").alias("subroot"), "path")
        found = self.below.paths(of_source.select("tree", "path"))
        found = found.join(F.broadcast(of_source.select("tree", "subroot")) if self.few_sources() else of_source.select("tree", "subroot"), "tree")
        return found.select("value.*", "path", "subroot", F.lit(self.root).alias("root"))

    def few_sources(self, most: int = 100_000) -> bool:
        """Whether one row per source is small enough to send to every task."""
        return self.sources.limit(most + 1).count() <= most


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> Manifest:
    """Manifest over leaves (doc_id, source, digest, and columns to carry along)."""
    keyed = leaves.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    keyed = stored(keyed.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves", "zstd")
    ranged, runs = placed(keyed, ["src"], ["doc_id", "digest", "tie"], "merkle-ranged")
    counted = runs.groupBy("src").agg(F.sum("here").alias("n"))
    sources, source_runs = placed(counted, [], ["src"], "merkle-sources")
    sources = stored(sources.join(F.broadcast(source_runs.select("part", "shift")), "part").select("src", "n", (F.col("at") + F.col("shift")).alias("tree")), "merkle-trees")
    named = stored(runs.join(sources, "src").select("part", "src", "shift", "tree", "n"), "merkle-shifts")
    values = F.struct("digest", *[c for c in keyed.columns if c not in ("digest", "src", "tie")])
    nodes = ranged.join(named, ["part", "src"]).select("tree", (F.col("at") + F.col("shift")).alias("place"), "n", values.alias("value"))
    below = grown(nodes, sources.agg(F.max("n")).first()[0] or 0, "merkle-level", fanout)
    subroots = stored(below.roots(), "merkle-subroots")
    total = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(total).cast("long").alias("n"), F.struct("digest").alias("value"))
    above = grown(tops, total, "merkle-top", fanout)
    last = above.roots().first()
    return Manifest(sources, below, above, last and last["digest"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step["before"], below, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def document_leaves(docs: DataFrame, altered_text: Column | None = None) -> DataFrame:
    """doc_id, source, digest of documents; with ``altered_text`` also the digest that the row has with it (null: the same)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    extra = [] if altered_text is None else [F.when(altered_text.isNotNull(), leaf_digest(altered_text)).alias("altered")]
    return rows.select("doc_id", "source", leaf_digest(F.col("text")).alias("digest"), *extra)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text")))
    proofs = manifest(document_leaves(table(spark, sf_dir, "documents"), tampered)).proofs()
    checked = proofs.withColumn("folded_root", folded(F.coalesce("altered", "digest"), F.col("path")))
    return checked.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = f"""
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
      || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS body,
    coalesce(strlen(text)::VARCHAR || ':' || translate(text, '{UPPER}', '{LOWER}'), '-') AS lowered,
    list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(doc_id::VARCHAR, '')])),
      lambda c, m: CASE WHEN m >= 0 THEN xor(c, m) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS crc
  FROM documents),
leaves AS (
  SELECT r, doc_id, source, sha256(head || body) AS leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % 5 = 0 THEN sha256(head || lowered) ELSE sha256(head || body) END AS shown
  FROM fields),
spots AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i
  FROM leaves),
below AS (
  SELECT tree, 0::BIGINT AS level, i, n, leaf AS digest FROM spots
  UNION ALL
  SELECT tree, level + 1, i // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM below WHERE n > 1 GROUP BY tree, level, i // 16),
above AS (
  SELECT -1::BIGINT AS tree, 0::BIGINT AS level, tree AS i, count(*) OVER () AS n, digest FROM below WHERE n = 1
  UNION ALL
  SELECT tree, level + 1, i // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY tree, level, i // 16),
nodes AS (
  SELECT *, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g
  FROM (SELECT * FROM below UNION ALL SELECT * FROM above) WINDOW run AS (PARTITION BY tree, level, i // 16 ORDER BY i)),
walk AS (
  SELECT r, tree, 0::BIGINT AS level, i, '' AS proof, shown AS folded FROM spots
  UNION ALL
  SELECT w.r, CASE WHEN x.n > 1 THEN w.tree ELSE -1 END, CASE WHEN x.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN x.n > 1 THEN w.i // 16 ELSE w.tree END,
    CASE WHEN x.n > 1 THEN proof || l || g ELSE proof END, CASE WHEN x.n > 1 THEN sha256(l || folded || g) ELSE folded END
  FROM walk w JOIN nodes x ON w.tree = x.tree AND w.level = x.level AND w.i = x.i WHERE x.n > 1 OR w.tree >= 0),
ends AS (
  SELECT w.r, w.proof, w.folded, x.digest AS root FROM walk w JOIN nodes x ON w.tree = x.tree AND w.level = x.level AND w.i = x.i WHERE w.tree = -1 AND x.n = 1)
SELECT s.doc_id, s.leaf, b.digest AS subroot, e.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = e.root AS verified
FROM spots s JOIN ends e ON s.r = e.r JOIN below b ON b.tree = s.tree AND b.n = 1
"""
