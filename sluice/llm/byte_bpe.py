"""Byte-level BPE: texts to token ids and back.

A text is cut by the tokenizer's pattern.  A piece that is a token is that token; any other is read from left to
right: from each place the automaton gives the longest token, which is taken if it may follow the token before it, else
the next shorter token that begins it is tried, and where none fits the token before is given up and the search goes
on from there.  Two tokens may be neighbours if merging their joined bytes by rank gives just these two; what has been
found for a pair is remembered.  A sequence of tokens in which all neighbours are compatible is the one that merging by
rank gives, so no merge of a piece is ever carried out.  Places that have been given up are never tried again, so the
work for a piece grows with its length.

The automaton takes strings, so bytes are read as Latin-1, one character for each byte.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.shipping import ship

#: Pieces and pairs that a worker remembers, and the longest piece it remembers.
KEPT_PIECES, KEPT_PAIRS, KEPT_LENGTH = 200_000, 200_000, 64
#: Bytes of texts or tokens that a task holds for one batch of results.
BATCH_BYTES = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: a line for each, base64 of the token's bytes and the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one vocabulary of ranks, of which every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.rank = {token.decode("latin-1"): r for token, r in ranks.items()}
        self.token = {r: t for t, r in self.rank.items()}
        self.pieces = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, array] = {}
        # A token that merging doesn't make from its own bytes can only be a whole piece.
        made = [t for t in self.rank if self.merged(t) == [t]]
        self.automaton = ahocorasick.Automaton()
        for t in made:
            self.automaton.add_word(t, self.rank[t])
        self.automaton.make_automaton()
        reached = set(made)
        #: The next shorter token that begins a token; -1 for a single byte.
        self.shorter = {self.rank[t]: next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in reached), -1) for t in made}
        self.length = {self.rank[t]: len(t) for t in made}

    def merged(self, word: str) -> list[str]:
        """A few bytes merged by rank, lowest first, leftmost of equals: the definition that compatibility goes back to."""
        parts = list(word)
        while len(parts) > 1:
            r, i = min((self.rank.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if r == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b`` may be neighbours."""
        found = self.pairs.get((a, b))
        if found is None:
            left, right = self.token[a], self.token[b]
            found = self.merged(left + right) == [left, right]
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def searched(self, piece: str) -> array:
        """Ids of a piece of Latin-1 characters that is no token."""
        longest, shorter, length, compatible = self.automaton.iter_long, self.shorter, self.length, self.compatible
        end, at = len(piece), 0
        open_at = bytearray(b"\1") * (end + 1)  # places that have not been given up
        out = array("i")
        token = next(longest(piece, 0))[1]
        while True:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[at + length[token]] and (last < 0 or compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == end:
                    return out
                token = next(longest(piece, at))[1]
            else:
                open_at[at] = 0
                token = out.pop()  # its end is closed now, so the next shorter one is tried from its start
                at -= length[token]

    def _of_piece(self, piece: str) -> array:
        latin = piece.encode().decode("latin-1")
        whole = self.rank.get(latin)
        found = array("i", [whole]) if whole is not None else self.searched(latin)
        if len(piece) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_PIECES:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str | None) -> array:
        """Ids of a text; special strings in it are text like any other."""
        out = array("i")
        known, of_piece = self.known.get, self._of_piece
        for match in self.pieces.finditer(text or ""):
            piece = match.group()
            out.extend(known(piece) or of_piece(piece))
        return out


def token_bytes(ranks: dict[bytes, int]) -> np.ndarray:
    """The bytes of each id; decoding needs no more of a vocabulary."""
    table = np.empty(max(ranks.values()) + 1, object)
    for token, r in ranks.items():
        table[r] = token
    return table


_codecs: dict[tuple[str, str], Codec] = {}
_tables: dict[str, np.ndarray] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file of ranks, built once in each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def _flushed(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of about ``BATCH_BYTES``, so that long texts never add up in a task."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row[1])
        if weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the token ids of every row of ``df``, as the library of the vocabulary gives them without special tokens.

    One narrow pass without shuffle over whole texts, however long.  Null and empty texts have no ids; bytes that are no
    UTF-8 count as U+FFFD; null keys, ties and repeated rows are returned row by row; other columns, whatever
    their names, are not read.  An empty table gives an empty result.
    """
    ship(df.sparkSession)
    out = df.select(df[key].alias("k"), F.make_valid_utf8(df[text].cast("string")).alias("t"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path, pattern).encode
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.list_(pa.int32())]
            rows = ((k, np.frombuffer(encoder(t.as_py()), np.int32)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1)))
            yield from _flushed(rows, kinds, ["k", "ids"], lambda ids: ids.nbytes)

    return out.mapInArrow(encoded, f"k {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the bytes that ``ids`` stand for, joined; null where ``ids`` is null.

    One narrow pass; an id that is null or no token fails with an error, as nothing stands for it.  All columns of
    ``df`` are passed on; one that is called like ``out`` is replaced.
    """
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() != out.lower()]
    plain = df.select(df[ids].cast("array<int>").alias("_ids"), F.struct(*(df[c].alias(f"c{i}") for i, c in enumerate(kept))).alias("_row"))
    row_kind = plain.schema["_row"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tables:
            _tables[path] = token_bytes(read_ranks(path))
        table = _tables[path]
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            found = [b"".join(table[values[e - n : e]].tolist()) if ok else None for e, n, ok in zip(ends, sizes, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["_row", "_decoded"])

    made = plain.mapInArrow(decoded, f"_row {row_kind}, _decoded binary")
    return made.select(*(F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(kept)), F.col("_decoded").alias(out))
