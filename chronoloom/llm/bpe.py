"""BPE encoding and decoding (operator 7): content-defined chunks, each encoded once and reused.

A rolling hash over the eight bytes before each white space picks chunk ends that depend on content
alone, so copies and shared passages fall into the same chunks wherever they stand. A Python worker
encodes a chunk once and reuses it for every document that holds it. Every join of two chunks is checked:
the words on either side of it, encoded together, must give what they give one by one. Where they
do not, the chunks are encoded again as one, until all joins left agree. Within a new chunk, words that
end at ASCII white space are reused in the same way, since the library alone takes more CPU time than all this; a
chunk with a word that begins with a combining mark goes to the library whole. Memos are bounded in bytes.
There is no shuffle: a table of all chunks would move more bytes than it saves.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, texts_of

_MASK = np.uint64(127)  # a chunk has about 128 words
_WORDS, _SHORT = 200_000, 64  # words of one of two generations of their memo (about 130 bytes each), and their longest
_CALL = 1024  # words or chunks in one call of the library, whose results are about a kilobyte each while it lasts
_MEMO, _LONG = 6 << 20, 4096  # bytes of one generation of a memo; longer keys aren't kept
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HEAD = re.compile(rb"[ \t-\r]*[^ \t-\r]*")

Part = bytes  # the ids, as int32: strings are made once for a whole text


class Memo:
    """A dictionary of about two times ``limit`` bytes at most: what the last generation didn't use is forgotten."""

    def __init__(self, limit: int = _MEMO):
        self.limit, self.size, self.now, self.old = limit, 0, {}, {}

    def get(self, key: bytes):
        if (found := self.now.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found, len(key))
        return found

    def put(self, key: bytes, value, size: int) -> None:
        if len(key) > _LONG:
            return
        if self.size > self.limit:
            self.old, self.now, self.size = self.now, {}, 0
        self.now[key] = value
        self.size += size + 300


class ChunkEncoder:
    """encode() and decode() of a ``tokenizers`` file without a decoder of its own, by reuse of chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.tokenizer.decoder is not None:
            raise ValueError("only tokenizers whose decode() joins the tokens by a space")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = np.full(max(vocab.values(), default=-1) + 1, "", object)
        self.names[list(vocab.values())] = list(vocab)
        self.digits = np.array([str(i) for i in range(len(self.names))], object)
        self.words: dict[bytes, Part] = {}
        self.older: dict[bytes, Part] = {}
        self.chunks, self.joins = Memo(), Memo(_MEMO // 3)

    def raw(self, parts: list[bytes]) -> list[Part]:
        """The parts of what the library encodes, each for itself."""
        out = []
        for at in range(0, len(parts), _CALL):
            texts = [p.decode("utf-8", "replace") for p in parts[at : at + _CALL]]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            data = np.fromiter(chain.from_iterable(ids), np.int32).tobytes()
            ends = np.cumsum([4 * len(x) for x in ids]).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    @staticmethod
    def spelled(names: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """For each text, which has so many of the ids, their names joined by a space."""
        flat, ends = names[ids].tolist(), np.cumsum(counts).tolist()
        return [" ".join(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def known(self, words: set[bytes]) -> dict[bytes, Part]:
        """The parts of words: those in the memo as they are, the others by the library."""
        now, old = self.words, self.older
        parts = {w: p for w in words if (p := now.get(w)) is not None or (p := old.get(w)) is not None}
        new = [w for w in words if w not in parts]
        parts.update(zip(new, self.raw(new)))
        if len(now) + len(parts) > _WORDS:
            self.older, self.words = now, {}
        self.words.update((w, p) for w, p in parts.items() if len(w) <= _SHORT)
        return parts

    def fresh(self, chunks: list[bytes]) -> list[Part]:
        """The parts of new chunks: from the parts of their words, or by the library as a whole."""
        split = [c.split() for c in chunks]
        parts = self.known(set().union(*split))
        marks = {w for w in parts if w[0] >= 0xCC and unicodedata.category(w.decode("utf-8", "replace")[0]).startswith("M")}
        whole = [k for k, words in enumerate(split) if marks and not marks.isdisjoint(words)]
        made = dict(zip(whole, self.raw([chunks[k] for k in whole])))
        return [made[k] if k in made else b"".join(map(parts.__getitem__, words)) for k, words in enumerate(split)]

    @staticmethod
    def cut(text: bytes) -> list[bytes]:
        """Chunks of a text; all but the first begin with a white space."""
        if len(text) < 256:
            return [text]
        data = np.frombuffer(text, np.uint8)
        spaces = np.flatnonzero(_SPACE[data[8:]]) + 8
        last = np.lib.stride_tricks.as_strided(data[:-7].view(), (len(text) - 7, 8), (1, 1))[spaces - 8]
        ends = spaces[(mix(np.ascontiguousarray(last).view(np.uint64)[:, 0]) & _MASK) == 0].tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]

    @staticmethod
    def seam(before: bytes, chunk: bytes) -> tuple[bytes, bytes]:
        """The last word before a join, and the white space and first word after it."""
        words = before.rsplit(None, 1)
        return words[-1] if words else b"", _HEAD.match(chunk)[0]

    def agreed(self, seams: set[tuple[bytes, bytes]]) -> set[tuple[bytes, bytes]]:
        """Those whose two sides, encoded together, give what they give one by one."""
        good = {s: k for s in seams if (k := self.joins.get(b"\0".join(s))) is not None}
        new = [s for s in seams if s not in good]
        parts = self.known({x.strip() for s in new for x in s})
        for (a, b), both in zip(new, self.raw([a + b for a, b in new])):
            good[a, b] = both == parts[a] + parts[b.strip()]
            self.joins.put(b"\0".join((a, b)), good[a, b], len(a) + len(b))
        return {s for s, k in good.items() if k}

    def encode_all(self, texts: list[str]) -> list[Part]:
        """The part of each whole text."""
        cuts = [self.cut(t.encode("utf-8", "replace")) for t in texts]
        seams = [[self.seam(a, b) for a, b in zip(cut, cut[1:])] for cut in cuts]
        good = self.agreed({s for row in seams for s in row})
        groups = []
        for cut, row in zip(cuts, seams):
            whole = [[cut[0]]]
            for chunk, seam in zip(cut[1:], row):
                if seam in good:
                    whole.append([chunk])
                else:
                    whole[-1].append(chunk)
            groups.append([b"".join(g) for g in whole])
        keys = {k for g in groups for k in g}
        parts = {k: p for k in keys if (p := self.chunks.get(k)) is not None}
        new = [k for k in keys if k not in parts]
        for k, p in zip(new, self.fresh(new)):
            parts[k] = p
            self.chunks.put(k, p, len(k) + len(p))
        return [b"".join([parts[k] for k in g]) for g in groups]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker."""
    return ChunkEncoder(path)


def bpe_encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded (text) of every document; a null text counts as empty.

    Empty texts give no ids and an empty decoded text. Every row is encoded for itself: repeated rows, and rows
    of one doc_id with different texts, give a row each, and a null doc_id stays null. An empty table gives no
    rows; other columns are ignored. Texts are encoded whole.
    """
    return _mapped(docs, tokenizer_path, digest=False)


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As ``bpe_encode``: doc_id, n_tokens and the SHA-256 of the joined ids and of the decoded text."""
    return _mapped(docs, tokenizer_path, digest=True)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _mapped(docs: DataFrame, path: str, digest: bool) -> DataFrame:
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, n_tokens long, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(path)
        for batch in small_batches(batches, 1 << 20):
            parts = coder.encode_all([t or "" for t in texts_of(batch)])
            counts, ids = np.array([len(p) // 4 for p in parts], np.int64), np.frombuffer(b"".join(parts), np.int32)
            decoded = coder.spelled(coder.names, ids, counts)
            if digest:
                made = [pa.array([_sha(text) for text in texts], pa.string()) for texts in (coder.spelled(coder.digits, ids, counts), decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), lists, pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
