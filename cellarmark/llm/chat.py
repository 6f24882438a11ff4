"""Chat formatting from event logs: conversations are rebuilt from streamed events, then rendered with a loss mask.

Events (conv_id, message, tie, seq, kind, role, text) say what happened to a message: ``start`` opens it with a role,
``delta`` appends, ``edit`` replaces its text, ``regenerate`` empties it and voids what was logged earlier for later
messages (they answered the discarded text). Logs are partitioned by conversation and sorted by message and
sequence, so one pass folds them holding a single message: a voiding event stands before all it can void.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles each ``<``, any backslashes, ``|`` gets one
more backslash, so a control string never stands inside a text and reading takes one away again; in roles backslash and line
feed are written as two characters. The mask covers assistant texts. One row is rendered per turn, so a
conversation of any length passes through in bounded memory.

Defined cases: null text or role counts as empty; a null turn comes first; turns with the same number are ordered by
role and text; a message that was only written before being voided vanishes; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm.common import table, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
TRAINED = "assistant"
SEGMENTS = "conv_id long, position long, formatted string, loss_start long, loss_end long"
SUMS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def written_role(role: str) -> str:
    return escaped(role).replace("\\", "\\\\").replace("\n", "\\n")


def read_role(role: str) -> str:
    return unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """One turn and where its trained text stands in it (an empty span where it is not trained)."""
    head, body = f"{START}{written_role(role)}\n", escaped(text)
    end = len(head) + (len(body) if role == TRAINED else 0)
    return f"{head}{body}{END}\n", len(head), end


def folded(events: Iterator[dict]) -> Iterator[tuple]:
    """(conv_id, role, text) of the final messages, from events sorted by conversation, message and sequence."""
    conv = message = role = None
    parts: list[str] = []
    begun, void_before = False, None
    for e in events:
        if not begun or e["conv_id"] != conv or (e["message"], e["tie"]) != message:
            if role is not None:
                yield conv, role, "".join(parts)
            if not begun or e["conv_id"] != conv:
                void_before = None
            begun, conv, message, role, parts = True, e["conv_id"], (e["message"], e["tie"]), None, []
            earlier = void_before  # what lower messages void; the message's own events do not void each other
        if earlier is not None and e["seq"] < earlier:
            continue
        if e["kind"] == "start":
            role = e["role"]
        elif e["kind"] == "delta":
            parts.append(e["text"])
        elif e["kind"] == "edit":
            parts = [e["text"]]
        elif e["kind"] == "regenerate":
            parts = []
            void_before = e["seq"] if void_before is None else max(void_before, e["seq"])
    if role is not None:
        yield conv, role, "".join(parts)


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, position, formatted turn and its loss span (code points in the turn), in order within each partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, position, any_yet = [], None, 0, False
        for conv_id, role, text in folded(e for b in batches for e in b.to_pylist()):
            position = position + 1 if any_yet and conv_id == last else 0
            any_yet, last = True, conv_id
            rows.append((conv_id, position, *rendered(role, text)))
            if len(rows) == 1000:
                yield as_batch(rows)
                rows = []
        yield as_batch(rows)

    ordered = events.repartition("conv_id").sortWithinPartitions("conv_id", "message", "tie", "seq")
    return ordered.select("conv_id", "message", F.to_json(F.struct("tie")).alias("tie"), "seq", "kind", "role", "text").mapInArrow(work, SEGMENTS)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SEGMENTS.split(", ")])


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of what the formatted text says, one row per conversation; the segments' order is kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: dict = {}

        def close(c: dict) -> None:
            if c:
                rows.append((c["id"], c["turns"], c["said"].hexdigest(), c["loss_chars"], c["loss"].hexdigest(), c["chars"]))

        for b in batches:
            for s in b.to_pylist():
                if not now or s["position"] == 0:
                    close(now)
                    now = {"id": s["conv_id"], "turns": 0, "said": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                text = s["formatted"]
                now["chars"] += len(text)
                for turn in TURN.finditer(text):
                    now["turns"] += 1
                    now["said"].update(f"{read_role(turn[1])}\n{unescaped(turn[2])}\n".encode("utf-8", "surrogatepass"))
                trained = unescaped(text[s["loss_start"] : s["loss_end"]])
                now["loss_chars"] += len(trained)
                now["loss"].update(trained.encode("utf-8", "surrogatepass"))
        close(now)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SUMS.split(", ")])

    return segments.mapInArrow(work, SUMS)


def logged(turns: DataFrame) -> DataFrame:
    """An event log that ends in these turns (conv_id, turn, role, text): user texts are begun and then edited, assistant
    texts stream in after a draft that was answered and regenerated."""
    text, role = text_or_empty(), text_or_empty("role")
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**55))).alias("message"),
        role.alias("role"),
        text.alias("text"),
        F.struct(role.alias("role"), F.xxhash64(text).alias("text"), F.monotonically_increasing_id().alias("row")).alias("tie"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def event(place: int, kind: str, said: Column, later: int = 0) -> Column:
        who = F.lit("user") if later else F.col("role")
        tie = F.struct(F.lit("").alias("role"), F.lit(0).cast("long").alias("text"), F.col("tie.row").alias("row")) if later else F.col("tie")
        return F.struct((F.col("message") + later).alias("message"), tie.alias("tie"), (F.col("message") * 16 + place).alias("seq"), F.lit(kind).alias("kind"), who.alias("role"), said.alias("text"))

    none = F.lit("")
    edited = F.array(event(0, "start", none), event(1, "delta", first), event(2, "edit", F.col("text")))
    redone = F.array(
        event(0, "start", none),
        event(1, "delta", F.concat(F.lit("draft: "), first)),
        event(2, "start", none, later=1),
        event(3, "delta", F.lit("answer to the draft"), later=1),
        event(4, "regenerate", none),
        event(5, "delta", first),
        event(6, "delta", rest),
    )
    return rows.select("conv_id", F.explode(F.when(F.col("role") == TRAINED, redone).otherwise(edited)).alias("e")).select("conv_id", "e.*")


def op3_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, and conversation -1, whose texts hold the template's own control strings."""
    said = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_conversations(logged(turns)))
