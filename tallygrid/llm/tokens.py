"""Encoding with a public byte-level BPE vocabulary, by speculating and verifying.

For each new word the longest tokens are taken greedily. Such a proposal is the encoding if and only if every two
neighbours are compatible, that is if merging their joined bytes gives just these two tokens again. The pairs of all
new words of a batch are looked up and, where new, tested together; only words with an incompatible pair go through
exact merging. Words and pairs are remembered by each worker, in tables that are emptied when full.

Edge cases, as tested: null and empty texts give an empty list; texts and words of any length are encoded whole;
strings of special tokens are ordinary text; repeated rows are kept; other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the public tokenizer: where its file lies here, and its pattern of words.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_WORDS, MOST_PAIRS = 500_000, 4_000_000


class Encoder:
    """The vocabulary, as ranks by token bytes, and what was learnt about words and pairs."""

    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.starts = {t[:i] for t in self.ranks for i in range(1, len(t) + 1)}
        self.words = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.merged = 0

    def merge(self, piece: bytes) -> list[int]:
        """Exact byte pair merging: always the pair of lowest rank, the leftmost of equals, by a heap."""
        if piece in self.ranks and len(piece) == 1:
            return [self.ranks[piece]]
        n = len(piece)
        after, prior, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        dead = bytearray(n)
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if dead[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
                continue
            gone = after[i]
            dead[gone], end[i], after[i] = 1, stop, after[gone]
            if after[i] < n:
                prior[after[i]] = i
                if (r := self.ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[after[i]]))
            if (h := prior[i]) >= 0 and (r := self.ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def greedy(self, piece: bytes) -> list[int]:
        """The longest token at each place."""
        out, at, n = [], 0, len(piece)
        while at < n:
            stop, best = at + 1, at + 1
            while stop <= n and piece[at:stop] in self.starts:
                if piece[at:stop] in self.ranks:
                    best = stop
                stop += 1
            out.append(self.ranks[piece[at:best]])
            at = best
        return out

    def _stands(self, token: int) -> bool:
        """Whether the token's own bytes merge into it."""
        if token not in self.alone:
            self.alone[token] = self.merge(self.bytes[token]) == [token]
        return self.alone[token]

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't known yet."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        new = [w for w in words if w not in self.known]
        if not new:
            return
        proposed = [self.greedy(w.encode()) for w in new]
        sizes = np.fromiter(map(len, proposed), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(new)), sizes)
        inner = owner[1:] == owner[:-1]
        codes, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        fits = np.empty(len(codes), dtype=bool)
        for i, code in enumerate(codes.tolist()):
            if code not in self.pairs:
                a, b = code >> 32, code & 0xFFFFFFFF
                self.pairs[code] = self._stands(a) and self._stands(b) and self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
            fits[i] = self.pairs[code]
        wrong = np.zeros(len(new), dtype=bool)
        np.logical_or.at(wrong, owner[1:][inner], ~fits[back])
        for i, (word, ids) in enumerate(zip(new, proposed, strict=True)):
            if wrong[i] or len(ids) == 1 and not self._stands(ids[0]):
                self.merged += 1
                ids = self.merge(word.encode())
            self.known[word] = tuple(ids)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.words(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split))
        if len(new) > MOST_WORDS // 2:  # a batch of very many words: text by text
            out = []
            for ws in split:
                self.learn(set(ws))
                out.append(list(chain.from_iterable(self._ids(w) for w in ws)))
            return out
        self.learn(new)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, ws))) for ws in split]

    def _ids(self, word: str) -> tuple[int, ...]:
        return self.known[word]


_ENCODERS: dict[int, Encoder] = {}


def shared_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file as a broadcast; it has a fixed size of under a megabyte."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: {len(data)} bytes are too many to send to every executor")
    return spark.sparkContext.broadcast(data)


def encoder(vocabulary) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, made once."""
    import zlib

    key = zlib.crc32(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary.value)
    return _ENCODERS[key]


def _batches(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with about so many characters, so that long texts don't pile up."""
    sizes = np.cumsum(np.nan_to_num(pa.compute.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(batch):
        base = sizes[at - 1] if at else 0.0
        end = max(at + 1, int(np.searchsorted(sizes, base + most)))
        yield batch.slice(at, end - at)
        at = end


def encode(df: DataFrame, ident: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``ident`` and ``ids`` of every row. No shuffle."""
    vocabulary = shared_vocabulary(df.sparkSession, path)
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        enc = encoder(vocabulary)
        for batch in batches:
            for part in _batches(batch):
                ids = enc.encode(part.column("text").to_pylist())
                ends = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column("ident"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["ident", "ids"])

    rows = df.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"ident {kind}, ids array<int>").withColumnRenamed("ident", ident)


def sizes(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and ``n_tokens``."""
    vocabulary = shared_vocabulary(df.sparkSession, path)
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        enc = encoder(vocabulary)
        for batch in batches:
            for part in _batches(batch):
                counts = pa.array([len(x) for x in enc.encode(part.column("text").to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], counts], names=[*kept, "n_tokens"])

    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = ", ".join(f"{k} {df.schema[c].dataType.simpleString()}" for c, k in zip(keep, kept, strict=True))
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint").select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "n_tokens")
