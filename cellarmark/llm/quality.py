"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The n-grams are of five characters (a character takes 12 bits of a 60-bit number, rare scripts share the last 62 codes).
Per language, the trusted documents' n-grams are counted within tasks, the counts are summed by n-gram, and
continuation counts, discounts, history totals and back-off weights of all orders come from joins and aggregates
over tables sharded by n-gram. Scoring takes one pass over the texts: the commonest entries, ``HEAD_BYTES`` at most
whatever the model's size, and a Bloom filter of fixed size over the others go to every worker and decide most n-grams there; each
n-gram that may need another entry is left with the rows that it occurs in, and an equi-join with the whole model for its three highest
orders and one for the two lowest give its probability. Both parts are added up by row.

A document is rejected when its bits per character exceed its language's threshold, the ``QUANTILE`` of trusted
documents held out of the training, drawn towards the threshold of all languages together: that one counts for
``POOLED_WEIGHT`` documents, the language's own for as many as it has held out, at every size.

Defined cases: null text counts as empty, a null language is one of its own; empty texts and languages without trusted
text have no score and are kept; repeated rows are scored each; labels with a null quality count as untrusted; without any
label all is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarmark.llm.bloom import bloom_words, holds, may_hold, words_of
from cellarmark.llm.common import ROW, bounded, discard, merged, numbered, sent, stored, table

ORDER = 5
BITS = 12
QUANTILE = 0.995
HELD_OUT = 10
"""One trusted document in this many sets thresholds instead of training."""
POOLED_WEIGHT = 200
"""Held-out documents that the threshold of all languages together counts for beside a language's own."""
STEPS = 1000
"""Resolution of the thresholds: steps per bit."""
HEAD_BYTES = 8 << 20
"""Size of the entries that go to every worker; the rest of the model is joined."""
ENTRY_BYTES = 16
"""An n-gram, its probability and its back-off weight in the head's arrays."""
UNITS = 1 << 20
"""Log probabilities are added up in whole numbers: so many to a bit."""
HELD_GRAMS = 1 << 20
"""Distinct n-grams that a counting task holds before it passes their counts on."""
NO_MODEL = -1
SYMBOLS_AT_ONCE = 200_000


def mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram ending at each character of the texts laid end to end (before a text stand zeros), and the texts' lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    symbols = np.where(symbols < 4032, symbols + np.uint64(1), np.uint64(4033) + symbols % np.uint64(62))
    padded = np.zeros(len(symbols) + (ORDER - 1) * len(texts), np.uint64)
    place = np.arange(len(symbols)) + np.repeat(np.arange(1, len(texts) + 1) * (ORDER - 1), lengths)
    padded[place] = symbols
    grams = np.zeros(len(symbols), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        grams = (grams << np.uint64(BITS)) | padded[place - back]
    return grams, lengths


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Language, row numbers and texts, in parts of bounded size."""
    languages = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
    texts = batch.column("text").to_pylist()
    for language in sorted(set(languages)):
        rows = [i for i in np.flatnonzero(languages == language).tolist() if texts[i]]
        part, size = [], 0
        for i in rows:
            part.append(i)
            size += len(texts[i])
            if size >= SYMBOLS_AT_ONCE:
                yield language, np.array(part), [texts[j] for j in part]
                part, size = [], 0
        if part:
            yield language, np.array(part), [texts[j] for j in part]


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def count_ngrams(texts: DataFrame) -> DataFrame:
    """lang, gram, c over (lang, text): each task sums what it reads before anything is shuffled, ``HELD_GRAMS`` n-grams at once."""

    def given(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for language, (grams, counts) in held.items():
            for at in range(0, len(grams), 100_000):
                some = grams[at : at + 100_000]
                yield pa.record_batch({"lang": pa.array([language] * len(some)), "gram": pa.array(some.view(np.int64)), "c": pa.array(counts[at : at + 100_000])})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for language, _, part in by_language(batch):
                found = held.setdefault(language, [np.empty(0, np.uint64), np.empty(0, np.int64)])
                grams, counts = np.unique(ngrams(part)[0], return_counts=True)
                held[language] = list(summed(np.append(found[0], grams), np.append(found[1], counts)))
                if sum(len(grams) for grams, _ in held.values()) > HELD_GRAMS:
                    yield from given(held)
                    held.clear()
        yield from given(held)

    return texts.mapInArrow(work, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, k, gram, p, backoff, seen of all orders from the highest order's counts (lang, gram, c).

    ``seen`` is an entry's own count (one for mere histories); the row of order 0, for unknown characters, counts as the commonest.
    """
    made = []

    def kept(df: DataFrame) -> DataFrame:
        made.append(stored(df, "quality-counts", "zstd"))
        return made[-1]

    levels = {ORDER: kept(counts)}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters can stand before
        shorter = levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask(k))).alias("gram"))
        levels[k] = kept(shorter.agg(F.count("*").alias("c")))
    parts, lower, weights = [], None, {}
    for k in range(1, ORDER + 1):
        level = levels[k].join(F.broadcast(discounts(levels[k])), "lang").withColumn("d", F.element_at(F.array("d1", "d2", "d3"), F.least("c", F.lit(3)).cast("int")))
        level = level.select("lang", "gram", "c", "d", F.shiftright("gram", BITS).alias("history"))
        history = level.groupBy("lang", "history").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("backoff"), F.count("*").alias("kinds"))
        weights[k] = history = kept(history)
        level = merged(level, history, ["lang", "history"])
        if k == 1:
            level = level.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            level = merged(level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask(k - 1)))), lower, ["lang", "suffix"])
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("backoff") * F.col("lower")
        level = kept(level.select("lang", "gram", "c", p.alias("p")))
        lower = level.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        parts.append((k, level))
    result = parts[-1][1].select("lang", F.lit(ORDER).alias("k"), "gram", "p", F.lit(1.0).alias("backoff"), F.col("c").alias("seen"))
    for k, level in parts[:-1]:
        follow = weights[k + 1].select("lang", F.col("history").alias("gram"), "backoff")
        entries = merged(level, follow, ["lang", "gram"], "full")
        result = result.unionByName(entries.select("lang", F.lit(k).alias("k"), "gram", "p", F.coalesce("backoff", F.lit(1.0)).alias("backoff"), F.coalesce("c", F.lit(1)).alias("seen")))
    unknown = weights[1].select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), (F.col("backoff") / (F.col("kinds") + 1)).alias("p"), F.lit(1.0).alias("backoff"), F.lit(1 << 62).alias("seen"))
    model = stored(result.unionByName(unknown), "quality-model", "zstd")
    discard(*made)
    return model


def discounts(level: DataFrame) -> DataFrame:
    """The three discounts of each language (one short row), from how many n-grams have counts one to four."""
    n = {i: F.greatest(F.sum((F.col("c") == i).cast("long")), F.lit(1)) for i in range(1, 5)}
    y = n[1] / (n[1] + 2 * n[2])
    least = lambda i: F.greatest(F.lit(0.0), i - (i + 1) * y * n[i + 1] / n[i]).alias(f"d{i}")
    return level.groupBy("lang").agg(least(1), least(2), least(3))


class Head:
    """The commonest entries of the model as sorted arrays by language and order, and a Bloom filter over all the others."""

    def __init__(self, entries: pa.Table, others: np.ndarray):
        self.others = others
        self.tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        languages = entries.column("lang").combine_chunks().dictionary_encode() if entries.num_rows else pa.array([], pa.string()).dictionary_encode()
        codes, orders = languages.indices.to_numpy(), entries.column("k").to_numpy()
        grams, p, backoff = entries.column("gram").to_numpy().view(np.uint64), entries.column("p").to_numpy(), entries.column("backoff").to_numpy()
        for code, language in enumerate(languages.dictionary.to_pylist()):
            for k in range(ORDER + 1):
                rows = np.flatnonzero((codes == code) & (orders == k))
                rows = rows[np.argsort(grams[rows])]
                self.tables[language, k] = (grams[rows], p[rows].astype(np.float32), backoff[rows].astype(np.float32))

    def find(self, language: str, k: int, grams: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Column 1 (p) or 2 (backoff) of each n-gram, nan where it has none, and whether an entry outside may hold it."""
        values, hit = np.full(len(grams), np.nan), np.zeros(len(grams), bool)
        table = self.tables.get((language, k))
        if table and len(table[0]):
            at = np.minimum(np.searchsorted(table[0], grams), len(table[0]) - 1)
            hit = table[0][at] == grams
            values[hit] = table[column][at[hit]]
        outside = ~hit
        outside[outside] = holds(self.others, entry_hashes(language, k, grams[outside]))
        return values, outside

    def units(self, language: str, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """-log2 p of each 5-gram in units, ``NO_MODEL`` if the language has none, and which 5-grams are left to the joins.

        The longest known suffix gives p, weighted for each longer history that is known.
        """
        p, weight = np.full(len(grams), np.nan), np.ones(len(grams))
        left, open_ = np.zeros(len(grams), bool), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            wanted = grams[open_] & np.uint64(mask(k))
            values, outside = self.find(language, k, wanted, 1)
            p[open_] = values
            left[open_[outside]] = True
            on = np.isnan(values) & ~outside  # a history that never ended a known n-gram has no p of its own
            open_, wanted = open_[on], wanted[on]
            if k > 1:
                values, outside = self.find(language, k - 1, wanted >> np.uint64(BITS), 2)
                weight[open_] *= np.where(np.isnan(values), 1.0, values)
                left[open_[outside]] = True
                open_ = open_[~outside]
        units = np.rint(-np.log2(p * weight) * UNITS)
        return np.where(np.isnan(units), NO_MODEL, units).astype(np.int64), left


def entry_hashes(language: str, k: int, grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of (language, order, n-gram)."""
    h = grams ^ np.uint64((zlib.crc32(language.encode()) << 32 | k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: the finalizer of splitmix64
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def filter_of(entries: DataFrame) -> np.ndarray:
    """Bloom filter, of fixed size, over entries (lang, k, gram)."""

    def hashed(batch: pa.RecordBatch) -> np.ndarray:
        languages, orders = np.array(batch.column("lang").to_pylist(), object), batch.column("k").to_numpy()
        grams, out = batch.column("gram").to_numpy().view(np.uint64), np.zeros(batch.num_rows, np.uint64)
        for language in set(languages):
            for k in range(ORDER + 1):
                rows = (languages == language) & (orders == k)
                out[rows] = entry_hashes(language, k, grams[rows])
        return out

    return words_of(entries.select("lang", "k", "gram"), hashed)


def head_of(model: DataFrame, most_entries: int) -> Head:
    """The entries seen most often, ``most_entries`` at most: those above the rarest step of counts that still fits."""
    step = F.floor(8 * F.log2("seen")).cast("int")
    least, total = 1 << 30, 0
    for r in model.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # at most 8 x 63 rows
        total += r["n"]
        if total > most_entries:
            break
        least = r["step"]
    entries = model.filter(step >= least).select("lang", F.col("k").cast("byte"), "gram", F.col("p").cast("float"), F.col("backoff").cast("float"))
    return Head(entries.toArrow(), filter_of(model.filter(step < least)))


def by_joins(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """lang, gram, p of distinct 5-grams (lang, gram) under the whole model.

    The last two characters are priced first and once for each pair of them, so no short n-gram is looked up by all 5-grams.
    """
    unknown = model.filter("k = 0").select("lang", "gram", "p")
    pairs = wanted.select("lang", F.col("gram").bitwiseAND(F.lit(mask(2))).alias("gram")).distinct()
    return backed_off(wanted, model, ORDER, 3, backed_off(pairs, model, 2, 1, unknown))


def backed_off(asked: DataFrame, model: DataFrame, high: int, low: int, lower: DataFrame) -> DataFrame:
    """lang, gram, p of n-grams of order ``high``, by one join for all orders down to ``low``; ``lower`` has those of the order below."""
    keys = []
    for k in range(high, low - 1, -1):
        part = F.col("gram").bitwiseAND(F.lit(mask(k)))
        keys.append(F.struct(F.lit(k).alias("k"), part.alias("key"), F.lit(f"p{k}").alias("slot")))
        if k > 1:
            keys.append(F.struct(F.lit(k - 1).alias("k"), F.shiftright(part, BITS).alias("key"), F.lit(f"b{k}").alias("slot")))
    entries = model.filter(F.col("k").between(max(1, low - 1), high)).select("lang", "k", F.col("gram").alias("key"), "p", "backoff")
    looked_up = merged(asked.select("lang", "gram", F.inline(F.array(*keys))), entries, ["lang", "k", "key"], "left")
    slots = [F.max(F.when(F.col("slot") == f"{kind}{k}", F.col(value))).alias(f"{kind}{k}") for k in range(low, high + 1) for kind, value in (("p", "p"), ("b", "backoff"))]
    level = looked_up.groupBy("lang", "gram").agg(*slots).withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask(low - 1))))
    level = level.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
    p = F.col("lower")
    for k in range(low, high + 1):
        p = F.coalesce(f"p{k}", F.coalesce(f"b{k}", F.lit(1.0)) * p)
    return level.select("lang", "gram", p.alias("p"))


def postings(grams: np.ndarray, which: np.ndarray, owners: np.ndarray, rows: np.ndarray) -> dict[str, pa.Array]:
    """One entry per n-gram: the row numbers that it occurs in, and how often in each."""
    pairs, counts = np.unique(which * len(rows) + owners, return_counts=True)
    gram = pairs // len(rows)
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    offsets = pa.array(np.append(starts, len(pairs)).astype(np.int32))
    return {
        "gram": pa.array(grams[gram[starts]].view(np.int64)),
        "rows": pa.ListArray.from_arrays(offsets, pa.array(rows[pairs % len(rows)])),
        "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
    }


def score(docs: DataFrame, model: DataFrame, most_entries: int) -> DataFrame:
    """Row number, doc_id, lang, n_chars and bits (of the whole text; null where the language has no model) of every document.

    One pass over the texts adds up what the model's head decides and leaves, for each other n-gram, the rows it occurs in;
    the joins give those their probabilities. Sums are of whole units, so that they do not depend on their order.
    """
    docs = docs if ROW in docs.columns else numbered(docs)
    names = ("lang", "gram", "rows", "counts")
    schema = pa.schema([(ROW, pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("units", pa.int64()), ("gram", pa.int64()), ("rows", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    with sent(docs.sparkSession, head_of(model, most_entries)) as head:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, numbers = batch.num_rows, batch.column(ROW).to_numpy()
                total, decided = np.zeros(n, np.int64), np.zeros(n, bool)
                for language, rows, texts in by_language(batch):
                    grams, lengths = ngrams(texts)
                    owner = np.repeat(rows, lengths)
                    for at in range(0, len(grams), SYMBOLS_AT_ONCE):
                        distinct, which = np.unique(grams[at : at + SYMBOLS_AT_ONCE], return_inverse=True)
                        owners = owner[at : at + SYMBOLS_AT_ONCE]
                        units, left = head.value.units(language, distinct)
                        own = (~left & (units != NO_MODEL))[which]
                        total += np.bincount(owners[own], units[which[own]], minlength=n).astype(np.int64)
                        decided[owners[own]] = True
                        if left.any():
                            joined = left[which]
                            found = postings(distinct, which[joined], owners[joined], numbers)
                            found["lang"] = pa.array([language] * len(found["gram"]))
                            yield pa.RecordBatch.from_arrays([found[f.name] if f.name in names else pa.nulls(len(found["gram"]), f.type) for f in schema], schema=schema)
                sizes = pa.array(np.array([len(t or "") for t in batch.column("text").to_pylist()], np.int64))
                document = [batch.column(ROW), batch.column("doc_id"), batch.column("lang"), sizes, pa.array(total, mask=~decided)]
                yield pa.RecordBatch.from_arrays([*document, *(pa.nulls(n, f.type) for f in list(schema)[5:])], schema=schema)

        fields = f"{ROW} long, doc_id long, lang string, n_chars long, units long, gram long, rows array<long>, counts array<long>"
        parts = stored(docs.select(ROW, F.col("doc_id").cast("long"), "lang", "text").mapInArrow(work, fields), "quality-parts", "zstd")
    left = parts.filter("gram is not null").select("lang", "gram", "rows", "counts")
    priced = merged(left, by_joins(left.select("lang", "gram").distinct(), model), ["lang", "gram"])
    units = F.round(-F.log2("p") * UNITS).cast("long")
    shares = priced.select(units.alias("unit"), F.explode(F.arrays_zip("rows", "counts")).alias("in")).groupBy(F.col("in.rows").alias(ROW)).agg(F.sum(F.col("unit") * F.col("in.counts")).alias("units"))
    documents = parts.filter("gram is null").select(ROW, "doc_id", "lang", "n_chars", "units")
    summed_up = documents.unionByName(shares, allowMissingColumns=True).groupBy(ROW)
    scored = stored(summed_up.agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.max("n_chars").alias("n_chars"), (F.sum("units") / UNITS).alias("bits")), "quality-scores")
    discard(parts)
    return scored


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """lang, n, most (bits per character) from trusted documents' steps; the row with a null lang holds all together."""
    cells = scored.groupBy("lang", "step").agg(F.count("*").alias("n"))
    cells = cells.unionByName(cells.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    along = Window.partitionBy("lang").orderBy("step")
    reached = cells.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return reached.filter(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(F.first("all").alias("n"), ((F.min("step") + 1) / STEPS).alias("most"))


def by_count(limits: DataFrame) -> DataFrame:
    """lang, most: each language's own threshold, drawn towards that of all together by its count (from ``thresholds``)."""
    overall = limits.filter("lang is null").agg(F.max("most").alias("overall"))  # one row
    n, weight = F.col("n"), F.lit(float(POOLED_WEIGHT))
    drawn = (n * F.col("most") + weight * F.col("overall")) / (n + weight)
    return limits.filter("lang is not null").join(F.broadcast(overall)).select("lang", drawn.alias("most"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """doc_id, lang, bits_per_char, most_bits, kept for every row of ``docs`` (doc_id, lang, text), from labels (doc_id, quality, toxic).

    Row numbers that ``docs`` brings in ``ROW`` are returned too.
    """
    carried = [ROW] if ROW in docs.columns else []
    docs = bounded(docs) if carried else numbered(bounded(docs))
    docs = docs.select(ROW, F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    trusted = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id").cast("long")).distinct()
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT))
    training = trusted.filter(fold > 0)
    with sent(docs.sparkSession, bloom_words(training, "doc_id")) as words:
        likely = may_hold(docs, "doc_id", words)
        # shuffled at every size: a broadcast join would run the filter's and the counts' Python processes side by side in one task
        known = likely.join(training.hint("shuffle_hash"), "doc_id", "left_semi")
        model = kneser_ney(count_ngrams(known.select("lang", "text")))
    scored = score(docs, model, head_bytes // ENTRY_BYTES)
    discard(model)
    per_char = F.when(F.col("n_chars") > 0, F.col("bits") / F.col("n_chars"))
    held_out = merged(scored, trusted.filter(fold == 0), "doc_id", "left_semi").filter("bits is not null and n_chars > 0")
    limits = stored(thresholds(held_out.select("lang", F.floor(per_char * STEPS).alias("step")), quantile), "quality-thresholds")
    overall = limits.filter("lang is null").agg(F.max("most").alias("overall"))  # one row
    judged = scored.join(by_count(limits), "lang", "left").join(F.broadcast(overall)).withColumn("most_bits", F.coalesce("most", "overall"))
    kept = F.coalesce(per_char <= F.col("most_bits"), F.lit(True))
    return judged.select(*carried, "doc_id", "lang", per_char.alias("bits_per_char"), "most_bits", kept.alias("kept"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
