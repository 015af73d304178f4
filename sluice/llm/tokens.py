"""Token counts: byte-pair merging with a heap over a linked list, without token ids.

The text is cut where no merge can ever reach: before a word mark and at line feeds when no piece
of the vocabulary spans them.  Each unit is merged on its own, its count is kept in a bounded table
of the Python worker, and a document's count is the sum over its units.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sluice.shipping import ship

MARK = "▁"
#: Units whose counts a worker remembers, and the longest unit it remembers.
KEPT_UNITS, KEPT_LENGTH = 600_000, 64


class PieceMerger:
    """Counts pieces of a sentencepiece BPE model by merging the lowest-ranked adjacent pair."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        usable = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        by_score = sorted(usable, key=lambda i: -model.get_score(i))
        self.rank = {model.id_to_piece(i): r for r, i in enumerate(by_score)}
        joined = [p for p in self.rank if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("a piece spans a word mark; words can't be merged apart")
        if any(c not in self.rank for p in joined for c in p):
            raise ValueError("a piece holds a symbol that is no piece; its bytes can't be counted apart")
        self.line_feed_apart = not any("\n" in p for p in joined)
        self.known: dict[str, int] = _Known(self._part)
        self.spaced: dict[str, int] = _Known(self.merged)

    def weight(self, symbol: str) -> int:
        """Tokens of a symbol that stays: one piece, or its bytes when the vocabulary lacks it."""
        return 1 if symbol in self.rank else len(symbol.encode())

    def merged(self, unit: str) -> int:
        """Initial symbols of ``unit`` less one for each merge."""
        rank_of = self.rank.get
        symbols: list[str | None] = list(unit)
        end = len(symbols)
        count = end + sum(len(c.encode()) - 1 for c in symbols if c not in self.rank)
        heap = [(r, i, pair) for i, pair in enumerate(map(str.__add__, unit, unit[1:])) if (r := rank_of(pair)) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, pair = pop(heap)
            left, j = symbols[i], after[i]
            if left is None or j >= end or left + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            count -= 1
            symbols[i], symbols[j] = pair, None
            after[i] = j = after[j]
            if j < end:
                before[j] = i
                longer = pair + symbols[j]
                if (r := rank_of(longer)) is not None:
                    push(heap, (r, i, longer))
            if (k := before[i]) >= 0:
                longer = symbols[k] + pair
                if (r := rank_of(longer)) is not None:
                    push(heap, (r, k, longer))
        return count

    def _part(self, part: str) -> int:
        if part[:1] == "\n":
            return self.weight("\n") + (self.merged(part[1:]) if len(part) > 1 else 0)
        return self.merged(MARK + part)

    def count(self, text: str | None) -> int:
        """Tokens of the whole text, as the library gives them without special tokens."""
        if not text:
            return 0
        text = text.replace(MARK, " ")
        parts = (text.replace("\n", " \n") if self.line_feed_apart else text).split(" ")
        if "" not in parts:
            return sum(map(self.known.__getitem__, parts))
        # Runs of spaces belong to the unit that follows them.
        marked = MARK + text.replace(" ", MARK)
        if self.line_feed_apart:
            lines = marked.split("\n")
            found = (len(lines) - 1) * self.weight("\n")
        else:
            lines, found = [marked], 0
        for line in lines:
            found += sum(map(self.spaced.__getitem__, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line)))
        return found


class _Known(dict):
    """Counts by unit, computed when missing; emptied when full, so its size is bounded."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, unit: str) -> int:
        found = self.of(unit)
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= KEPT_UNITS:
                self.clear()
            self[unit] = found
        return found


_mergers: dict[str, PieceMerger] = {}


def merger(model_path: str) -> PieceMerger:
    """The merger of a model file, loaded once in each Python worker."""
    if model_path not in _mergers:
        _mergers[model_path] = PieceMerger(model_path)
    return _mergers[model_path]


def count_tokens(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` for every row of ``df``.

    One narrow pass without shuffle; texts never leave their partition.  Null and empty texts have 0
    bytes and 0 tokens; null keys, ties and repeated rows are returned row by row; other columns of
    ``df``, whatever their names, are not read.  An empty table gives an empty result.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(model_path).count
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            tokens = pa.array([count(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, size, tokens], ["k", "n_bytes", "n_tokens"])

    out = df.select(df[key].alias("k"), df[text].cast("string").alias("t"))
    return out.mapInArrow(counted, f"k {kind}, n_bytes long, n_tokens long").withColumnRenamed("k", key)
