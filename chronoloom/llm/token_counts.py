"""Token counts (operator 9): heap-and-linked-list byte-pair merging that counts and emits no ids.

A SentencePiece BPE text is cut where a merge can never cross (no piece of the vocabulary has a
space mark after another character), and each unit is merged by repeatedly popping the
lowest-rank adjacent pair; its count is its initial symbols minus its merges. Units repeat, so a
bounded memo of two generations holds their counts. There is no shuffle: one map over the scan.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")
_MEMO = 400_000
_SHIFT = 40
_POSITION = (1 << _SHIFT) - 1


@lru_cache(maxsize=2)
def counter_of(path: str) -> PieceCounter:
    """One counter for all tasks of a Python worker."""
    return PieceCounter(path)


class PieceCounter:
    """Counts the pieces that a BPE SentencePiece model with byte fallback gives for a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(model.get_piece_size())
        self.ranks = {
            model.id_to_piece(i): -model.get_score(i)
            for i in pieces
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in self.ranks):
            raise ValueError("a piece has a space mark inside; texts can't be cut at space marks")
        scores = {s: (k + 1) << _SHIFT for k, s in enumerate(sorted(set(self.ranks.values())))}
        self.ranks = {p: scores[s] for p, s in self.ranks.items()}  # equal scores stay equal: the leftmost pair goes first
        self.chars = {p for p in self.ranks if len(p) == 1}
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def unit(self, symbols: str) -> int:
        """Merge one unit: a heap of (rank, left position) in one integer, symbols in a linked list."""
        ranks, n = self.ranks, len(symbols)
        parts = list(symbols)
        weight = [1] * n
        if not self.chars.issuperset(parts):
            weight = [1 if c in ranks else len(c.encode("utf-8", "surrogatepass")) for c in parts]
        count = sum(weight)
        heap = [r | i for i, p in enumerate(map(add, parts, parts[1:])) if (r := ranks.get(p))]
        if not heap:
            return count
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & _POSITION
            j = after[i]
            if j >= n or not parts[i] or ranks.get(pair := parts[i] + parts[j]) != top - i:
                continue  # one side has been merged since
            count -= weight[i] + weight[j] - 1
            weight[i], parts[i], parts[j] = 1, pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get(pair + parts[k]):
                    heapq.heappush(heap, r | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(parts[h] + pair)):
                heapq.heappush(heap, r | h)
        return count

    def _new(self, word: str) -> int:
        value = self.older.get(word) or self.unit(MARK + word)
        if len(word) <= 64:
            if len(self.memo) >= _MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[word] = value
        return value

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text or "  " in text or text[0] == " ":
            words = [u[1:] for u in _UNITS.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        get, new, total = self.memo.get, self._new, 0
        for word in words:
            total += get(word) or new(word)
        return total


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every document.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results; an empty
    table gives no rows; other columns are ignored. Texts of any length are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_path)
        for batch in small_batches(batches):
            texts = [t or "" for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
