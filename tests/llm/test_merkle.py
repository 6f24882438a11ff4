"""The Merkle manifest against a direct recursion."""

import hashlib
import zlib

import pytest

from cellarmark.llm import merkle
from cellarmark.session import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, src string, place int, digest string, part int, at long, tree int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(digests, fanout):
    """All levels, the single node last; and each leaf's (before, after) per level."""
    rows, paths = list(digests), [[] for _ in digests]
    spots = list(range(len(digests)))
    while len(rows) > 1:
        runs = [rows[a : a + fanout] for a in range(0, len(rows), fanout)]
        for leaf, at in enumerate(spots):
            run = runs[at // fanout]
            paths[leaf].append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
        spots = [at // fanout for at in spots]
        rows = [h("".join(run)) for run in runs]
    return rows[0], paths


def direct(rows, fanout=16):
    """Expected rows of op12 over (doc_id, text, lang, source, n_chars)."""
    made = {}
    for doc_id, text, lang, source, n_chars in rows:
        head = "".join(map(field, (doc_id, source, lang, n_chars)))
        leaf = h(head + field(text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        made.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, h(head + field(lowered(text))) if hit and text is not None else leaf))
    order = sorted(made, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for source in order:
        made[source].sort(key=lambda x: x[0])
        inner[source] = levels([x[2] for x in made[source]], fanout)
    root, outer = levels([inner[s][0] for s in order], fanout)
    out = []
    for k, source in enumerate(order):
        subroot, paths = inner[source]
        for (_, doc_id, leaf, shown), path in zip(made[source], paths):
            whole = path + outer[k]
            folded = shown
            for before, after in whole:
                folded = h(before + folded + after)
            out.append((doc_id, leaf, subroot, root, h("".join(b + a for b, a in whole)), folded, folded == root))
    return sorted(out, key=str)


def as_table(spark, rows):
    path = f"{shared_folder(spark)}/merkle-{abs(hash(str(rows)))}"
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in rows], SCHEMA)
    frame.repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return path


CASES = {
    "odd": [(1, "Text A", "en", "s1", 6), (1, "Text A", "en", "s1", 6), (1, "Other", None, "s1", None), (None, "ÄA", "de", "s1", 2), (None, None, None, None, None), (9, "", "en", None, 0), (5, "ONE", "fr", "é", 3), (25, "X" * 300_000, "fr", "Z", 3)],
    "sizes": [(i, f"T{i} Ärger", "en", s, i) for s, n in (("a", 1), ("b", 16), ("c", 17), ("d", 257), ("e", 300)) for i in range(n)],
    "many sources": [(i, f"T{i}", "en", f"s{i}", i) for i in range(270)],
    "one source": [(i, f"T{i}", "en", "s", i) for i in range(33)],
    "one row": [(4, "ABC", "en", "s", 3)],
    "one row repeated": [(7, "ABC", "en", "s", 3)] * 40,
}


@pytest.mark.parametrize("case", CASES)
def test_equals_the_recursion(spark, case):
    rows = CASES[case]
    got = [tuple(r) for r in merkle.op12_merkle_manifest(spark, as_table(spark, rows)).collect()]
    assert sorted(got, key=str) == direct(rows)


def test_empty_table(spark):
    path = as_table(spark, [])
    assert merkle.op12_merkle_manifest(spark, path).collect() == []
    assert merkle.manifest(merkle.document_leaves(spark.read.parquet(f"{path}/documents.parquet"))).root is None


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = [tuple(r) for r in merkle.op12_merkle_manifest(spark, sf_dir).collect()]
    assert sorted(got, key=str) == direct(rows)


def test_other_fanout_and_carried_columns(spark):
    rows = CASES["sizes"]
    leaves = merkle.document_leaves(spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in rows], SCHEMA))
    found = merkle.manifest(leaves.withColumn("note", merkle.F.col("doc_id") * 2), fanout=3).proofs()
    checked = found.select("doc_id", "note", "root", merkle.folded(merkle.F.col("digest"), merkle.F.col("path")).alias("folded")).collect()
    assert len(checked) == len(rows) and all(r["note"] == 2 * r["doc_id"] and r["folded"] == r["root"] for r in checked)
