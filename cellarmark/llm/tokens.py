"""Token ids of whole texts, by a public vocabulary file and the tokenizers library.

The vocabularies used here drop white space and let no token span it, so a text's ids are those of its
space-separated pieces in order. A batch is cut into pieces by Arrow, its distinct pieces are encoded
once by the library (each worker remembers recent ones), and the ids are gathered back per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cellarmark.llm.common import byte_slices

PIECES_KEPT = 150_000
"""Pieces in each of a worker's two generations (together some 50 MB); older ones are encoded anew."""

# Letters that the vocabulary's normalizer only lower-cases and its splitter keeps together.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# A token always ends between these two.
LETTER_THEN_SIGN = "([a-zß-öø-ÿ])([!#$%&()*+,./:;=?@|~-])"


class PieceIds(dict):
    """Little-endian 32-bit ids of a space-free piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.words = self.tokenizer.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_names = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256) if chr(c).isprintable()}
        config = self.tokenizer.to_str()
        self.splits_letters = "[\\\\p{L}]+" in config and '"Lowercase"' in config
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            value = self.fresh(piece)
        if len(self) >= PIECES_KEPT:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value

    def fresh(self, piece: str) -> bytes:
        if self.splits_letters and LETTERS.fullmatch(piece):
            word = piece.lower()
            return b"".join([self.id_bytes[t.id] for t in self.words.tokenize(word if word.isascii() else word.translate(self.byte_names))])
        return b"".join([self.id_bytes[i] for i in self.tokenizer.encode(piece, add_special_tokens=False).ids])


_LOADED: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    if path not in _LOADED:
        _LOADED[path] = PieceIds(path)
    return _LOADED[path]


def encode_texts(path: str, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (null: no ids), each followed by ``end_id``: number of ids per text, all ids in order."""
    known = piece_ids(path)
    texts = pc.fill_null(texts, "")
    if known.splits_letters:
        # Special tokens are found before lower-casing, so texts that may hold one keep their case.
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), LETTER_THEN_SIGN, r"\1 \2")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, plain)
    pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = pieces.flatten().dictionary_encode()
    values = list(map(known.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    starts = np.cumsum(sizes) - sizes
    if end_id is not None:  # one more piece at the end of each text
        flat, starts, sizes = np.append(flat, np.uint32(end_id)), np.append(starts, len(flat)), np.append(sizes, 1)
    ends = np.asarray(pieces.offsets)[1:] - np.asarray(pieces.offsets)[0]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if end_id is not None:
        index = np.insert(index, ends, len(sizes) - 1)
        ends = ends + np.arange(1, len(ends) + 1)
    length = sizes[index]
    after = np.cumsum(length)
    total = int(after[-1]) if len(after) else 0
    ids = flat[np.repeat(starts[index] - (after - length), length) + np.arange(total)]
    bounds = np.concatenate([[0], after])[ends]
    return np.diff(bounds, prepend=0), ids


def encode_batches(path: str, batches: Iterator[pa.RecordBatch], end_id: int, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, ids per row and ids, in slices of about ``most_bytes`` of text: memory follows the slice, not the batch."""
    for batch in batches:
        for a, b in byte_slices(batch.column("text"), most_bytes):
            rows = batch.slice(a, b - a)
            yield rows, *encode_texts(path, rows.column("text"), end_id)


def encode(path: str, text: str | None) -> list[int]:
    """Ids of one text."""
    return encode_texts(path, pa.array([text], pa.string()))[1].tolist()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package keeps a public vocabulary file; any other path serves as well."""
    import public_tokenizers

    return public_tokenizers.path(name)
