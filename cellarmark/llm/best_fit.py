"""Best-fit packing of token ids, certified by dual-feasible lower bounds.

Documents are encoded once and cut only where they exceed the capacity. Whole-capacity pieces are sequences of their own; all
others are dealt at random to partitions of a bounded number of pieces, and each partition is packed best-fit decreasing.
Dual-feasible functions (Martello-Toth's rounding, Fekete-Schepers' multiples and small-item steps) over its lengths
bound the bins it needs from below. Where best-fit decreasing leaves a gap, the partition is also packed bin by bin, each bin
with the pieces that fit its room best, and the better packing counts. A partition that meets its bound is certified:
all its bins are final but the one with most room. The others keep their full bins only. What is left open is exchanged: it is
dealt anew to fewer or other partitions, which are packed again, as long as that saves bins. The bound of all lengths
together certifies the whole (``certificate``).

Defined cases: null text counts as empty (the end id alone); repeated rows are packed as often as they occur, each row's pieces on
their own; null ids are kept; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm.common import bounded, byte_slices, stored, table
from cellarmark.llm.tokens import piece_ids, vocabulary

CAPACITY = 2048
END_ID = 0
GROUP = 16_384
"""Pieces that one task packs together, on average."""
ENCODE_BYTES = 4 << 20
PIECES_KEPT = 200_000
"""Pieces in each of a worker's two generations (together some 80 MB)."""
LONGEST_KEPT = 64
"""Characters of the longest pieces that a worker remembers."""

LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
WHITE = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"
# A space between white space (or at the end after it) belongs to a longer run; texts with one are encoded as they are.
SPACE_RUN = f"{WHITE} (?:{WHITE}|$)"
# A byte-level vocabulary's groups also end between a letter and a plain sign, and around a single line end.
LETTER_THEN_SIGN = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])"
LINE_END = r"([^\s\pZ\x00-\x1f\x{85}])\n([^\s\pZ\x00-\x1f\x{85}])"
CUT = "\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PLACED = "key long, length long, bucket long, bin int, offset long, open boolean"


class BytePieces(dict):
    """Little-endian 32-bit ids of pieces by a byte-level vocabulary; recent pieces are remembered in two generations."""

    def __init__(self, path: str, kept: int = PIECES_KEPT):
        super().__init__()
        self.source, self.kept, self.older = piece_ids(path), kept, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            if LETTERS.fullmatch(piece):  # one group: the library's splitter has nothing to split
                name = piece if piece.isascii() else piece.translate(self.source.byte_names)
                value = b"".join([self.source.id_bytes[t.id] for t in self.source.words.tokenize(name.replace(" ", "Ġ"))])
            else:
                value = b"".join([self.source.id_bytes[i] for i in self.source.tokenizer.encode(piece, add_special_tokens=False).ids])
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


_KNOWN: dict[str, BytePieces] = {}


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (null: none) by a byte-level vocabulary: number of ids per text, all ids in order.

    Texts are cut where a token group must end, and each distinct piece is encoded once; a piece may begin with a space.
    """
    if path not in _KNOWN:
        _KNOWN[path] = BytePieces(path)
    texts = pc.fill_null(texts, "")
    marked = pc.replace_substring(texts, " ", CUT + " ")
    marked = pc.replace_substring_regex(marked, LETTER_THEN_SIGN, r"\1" + CUT + r"\2")
    marked = pc.replace_substring_regex(marked, LINE_END, r"\1" + CUT + "\n" + CUT + r"\2")
    as_is = pc.or_(pc.match_substring(texts, CUT), pc.match_substring_regex(texts, SPACE_RUN))
    as_is = pc.or_(as_is, pc.match_substring(texts, "<|"))  # may hold a special token
    pieces = pc.split_pattern(pc.if_else(as_is, "", marked), CUT)
    coded = pieces.flatten().dictionary_encode()
    values = [_KNOWN[path][piece] if piece else b"" for piece in coded.dictionary.to_pylist()]
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    starts = np.cumsum(sizes) - sizes
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.asarray(pieces.offsets).astype(np.int64)
    length = sizes[index]
    after = np.concatenate([[0], np.cumsum(length)])
    ids = flat[np.repeat(starts[index] - after[:-1], length) + np.arange(after[-1])]
    bounds = after[offsets - offsets[0]]
    rows = np.flatnonzero(as_is.to_numpy(zero_copy_only=False))
    if len(rows):
        whole = {r: np.array(_KNOWN[path].source.tokenizer.encode(texts[r].as_py(), add_special_tokens=False).ids, "<u4") for r in rows.tolist()}
        parts, at = [], 0
        for r in rows.tolist():
            parts += [ids[bounds[at] : bounds[r]], whole[r]]
            at = r
        ids = np.concatenate([*parts, ids[bounds[at] :]])
        counts = np.diff(bounds)
        counts[rows] = [len(whole[r]) for r in rows.tolist()]
        return counts, ids
    return np.diff(bounds), ids


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole capacities, preceded by what is over."""
    whole, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * whole


def encoded_pieces(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents with their ids (little-endian 32-bit) and those ids' crc32."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), ENCODE_BYTES):
                counts, ids = encode_texts(vocabulary_path, batch.column("text").slice(a, b - a))
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
                data, rows, at = memoryview(ids).cast("B"), [], 0
                for doc_id, n in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), (counts + 1).tolist(), strict=True):
                    start = 0
                    for piece, length in enumerate(cut(n, capacity)):
                        part = data[4 * (at + start) : 4 * (at + start + length)]
                        rows.append((doc_id, piece, start, length, zlib.crc32(part), bytes(part)))
                        start += length
                    at += n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that ``counts[x]`` items of each length x can need, by three families of dual-feasible functions."""
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = np.asarray(counts, np.int64)
    number, size = np.cumsum(counts), np.cumsum(counts * x)
    steps = np.arange(0, capacity // 2 + 1)
    # Rounding: items over capacity - step fill a bin, those under step count nothing, the others by size.
    middle = size[capacity - steps] - np.where(steps > 0, size[steps - 1], 0)
    best = int(np.max(-(-(capacity * (number[-1] - number[capacity - steps]) + middle) // capacity)))
    for k in range(1, 21):  # multiples: (k + 1) * x / capacity, rounded down where it is no integer
        scaled = np.where((k + 1) * x % capacity == 0, k * x, capacity * ((k + 1) * x // capacity))
        best = max(best, -(-int(counts @ scaled) // (k * capacity)))
    large, small = 2 * x > capacity, 2 * x <= capacity
    for step in np.unique(np.concatenate([capacity // np.arange(2, 41), np.flatnonzero(counts[: capacity // 2 + 1])])):
        if step:  # small-item steps: how many items of ``step`` a bin with this one cannot take any more
            m = capacity // int(step)
            value = np.where(large, m - (capacity - x) // step, (small & (x >= step)).astype(np.int64))
            best = max(best, -(-int(counts @ value) // m))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r of rooms: some bin has r ids of room
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, made = capacity, made, made + 1
        bins[i], offsets[i] = chosen, capacity - room
        by_room[room - length].append(chosen)
        rooms |= 1 << (room - length)
    return bins, offsets


def fullest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, bin by bin: the longest item left, and a set of others that fits its room best.

    Bit r of ``reach`` says that some of the items looked at, longest first, fill r of the room; looking ends at a full bin.
    """
    waiting: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    order = sorted(waiting, reverse=True)
    bins, offsets, made = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64), 0
    while order:
        room, reach, steps = capacity - order[0], 1, []
        within = (1 << (room + 1)) - 1
        for x in order:
            for _ in range(min(len(waiting[x]) - (x == order[0]), room // x)):
                more = (reach | reach << x) & within
                if more == reach:
                    break
                steps.append((x, reach))
                reach = more
            if reach >> room:
                break
        chosen, filled, at = [order[0]], reach.bit_length() - 1, 0
        for x, before in reversed(steps):
            if filled and not before >> filled & 1:
                chosen.append(x)
                filled -= x
        for x in chosen:
            i = waiting[x].pop()
            bins[i], offsets[i], at = made, at, at + x
            if not waiting[x]:
                order.remove(x)
        made += 1
    return bins, offsets


def packed_once(pieces: DataFrame, buckets: int, turn: int, capacity: int) -> DataFrame:
    """key, length, bucket, bin, offset and open (goes to the exchange) of pieces (key, length).

    Open are, in a certified bucket, the pieces of the bin with most room, in any other those outside full bins.
    """

    def pack_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets = best_fit(lengths, capacity)
        if bins.max() >= bound:
            bins, offsets = min((bins, offsets), fullest(lengths, capacity), key=lambda packed: packed[0].max())
        fill = np.bincount(bins, lengths).astype(np.int64)
        certified = len(fill) == bound
        opened = (bins == np.argmin(fill)) & (fill.min() < capacity) if certified else fill[bins] < capacity
        return pd.DataFrame({"key": rows["key"], "length": lengths, "bucket": key[0], "bin": bins, "offset": offsets, "open": opened})

    dealt = pieces.select("key", "length", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(buckets)).alias("bucket"))
    return stored(dealt.groupBy("bucket").applyInPandas(pack_bucket, PLACED), f"best-fit-{turn}")


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id and offset of every piece.

    Ids are stored once and carried by no shuffle but the last join. Rounds end when everything open fits one partition or an
    exchange saves no bin, in which case its result is dropped and the earlier one stays.
    """
    pieces = stored(encoded_pieces(docs, vocabulary_path, end_id, capacity).withColumn("key", F.monotonically_increasing_id()), "best-fit-pieces", "zstd")
    sequence = (F.lit(1 << 62) + F.col("key")).alias("sequence_id")
    final = pieces.filter(F.col("length") == capacity).select("key", sequence, F.lit(0).cast("long").alias("offset"))
    active = pieces.filter(F.col("length") < capacity).select("key", "length")
    count, turn, held, used = active.count(), 0, None, 0
    while count:
        buckets = -(-count // group)
        placed = packed_once(active, buckets, turn, capacity)
        if held is not None:
            if bin_count(placed) >= used:
                break
            final = final.unionByName(as_sequences(held.filter("not open"), turn - 1))
        held, active, turn = placed, placed.filter("open").select("key", "length"), turn + 1
        used, count = bin_count(placed.filter("open")), active.count() if buckets > 1 else 0
    if held is not None:
        final = final.unionByName(as_sequences(held, turn))
    return pieces.join(final, "key").drop("key")


def bin_count(placed: DataFrame) -> int:
    return placed.filter("offset = 0").count()


def as_sequences(placed: DataFrame, turn: int) -> DataFrame:
    """key, sequence_id, offset; an id holds the turn (12 bits), the bucket (27) and the bin (23)."""
    number = F.lit(turn).cast("long") * (1 << 50) + F.col("bucket") * (1 << 23) + F.col("bin")
    return placed.select("key", number.alias("sequence_id"), "offset")


def certificate(pieces: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences used, and the fewest that any packing of these pieces needs; at most ``capacity`` counts reach the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return pieces.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
