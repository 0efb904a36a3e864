"""Byte-level BPE by a rank queue over a hierarchical bitmap.

Every match of the split pattern (a pre-token) becomes a linked list of byte
parts. ``RankQueue`` holds one bucket of list positions per merge rank and a
bitmap of the buckets in use, in two levels: finding the next rank takes one
find-first-set per level, whatever the length of the pre-token. A bucket gives
its leftmost position first. An entry is stale, and skipped, when its position
was merged away or its pair has another rank by now. A pre-token of n bytes so
takes O(n log n) steps, where rescanning all pairs takes O(n^2).

Results of short pre-tokens are remembered up to a bound; long ones are not.
Text that is null counts as empty: no ids, and nothing to decode.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeload.llm.common import extended, release, small
from lakeload.llm.common import free_name as _free
from lakeload.llm.splitting import library_class, splitter

#: Pre-tokens of up to so many characters are remembered, and so many of them.
MEMO_CHARS = 40
MEMO_SIZE = 250_000


#: Bits of a word of the queue's lower level.
WIDTH = 256


class RankQueue:
    """Positions by merge rank; the smallest rank first, then the leftmost position.

    Level 0 has a bit per rank, in words of ``WIDTH`` bits; level 1 has a bit per
    word of level 0. Python's integers take any width, so two levels do.
    """

    def __init__(self, ranks: int) -> None:
        self.words = [0] * (ranks // WIDTH + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank // WIDTH
        self.words[word] |= 1 << rank % WIDTH
        self.top |= 1 << word

    def pop(self) -> tuple[int, int] | None:
        """Remove the first entry and return its rank and position."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = word * WIDTH + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.words[word] = bits = bits ^ low
        if not bits:
            self.top = top ^ (1 << word)
        return rank, bucket[0]


class Vocabulary:
    """Merge ranks of a rank file (one base64 token and its rank a line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces = {rank: token for token, rank in ranks.items()}
        self.split = splitter(pattern, library_class)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.packed = _Memo(self, lambda ids: array("i", ids).tobytes(), MEMO_SIZE // 4)
        self.written = _Memo(self, lambda ids: (" ".join(map(str, ids)), self.decode(ids)))

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        find, n = ranks.get, len(data)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: merged away
        before = list(range(-1, n - 1))
        now = [find(data[i : i + 2]) for i in range(n - 1)]  # rank of the pair that starts here
        now.append(None)
        # the queue's push and pop, written out: calls would cost more than their work
        buckets, words, top = self.queue.buckets, self.queue.words, 0
        fresh = [(rank, i) for i, rank in enumerate(now) if rank is not None]
        while True:
            for rank, i in fresh:
                bucket = buckets.get(rank)
                if bucket is not None:
                    heappush(bucket, i)
                    continue
                buckets[rank] = [i]
                word = rank // WIDTH
                words[word] |= 1 << rank % WIDTH
                top |= 1 << word
            if not top:
                break
            fresh = []
            last = top & -top
            word = last.bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word * WIDTH + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits ^ low
                if bits == low:
                    top ^= last
            if now[i] != rank:
                continue  # stale: the pair that was queued is no longer here
            j = end[i]
            k = end[j]
            now[j] = None
            end[j] = 0
            end[i] = k
            if k < n:
                before[k] = i
                now[i] = new = find(data[i : end[k]])
                if new is not None:
                    fresh.append((new, i))
            else:
                now[i] = None
            h = before[i]
            if h >= 0:
                now[h] = new = find(data[h:k])
                if new is not None:
                    fresh.append((new, h))
        out, i = [], 0
        while i < n:
            k = end[i]
            out.append(ranks[data[i:k]])
            i = k
        return out

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in self.split(text or ""):
            ids.extend(self.merge(piece.encode("utf-8")))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class _Memo(dict):
    """What is made of the ids of pre-tokens seen before, in two generations."""

    def __init__(self, vocabulary: Vocabulary, make: Callable[[list[int]], object], size: int = MEMO_SIZE) -> None:
        super().__init__()
        self.vocabulary, self.make, self.size = vocabulary, make, size
        self.older: dict[str, object] = {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, piece: str) -> object:
        made = self.older.get(piece)
        if made is None:
            made = self.make(self.vocabulary.merge(piece.encode("utf-8")))
            if len(piece) > MEMO_CHARS:
                return made
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[piece] = made
        return made


@lru_cache(maxsize=2)
def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return Vocabulary(ranks, pattern)


def encode_table(
    docs: DataFrame, path: str, pattern: str, text: str = "text", check: bool = False
) -> DataFrame:
    """All columns of ``docs`` plus ``ids`` (array of int), the token ids of the whole text.

    ``path`` names the rank file; every executor needs it under that name. With
    ``check`` a last column ``round_trip`` tells that decoding gives the text again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path, pattern)
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids_of = vocabulary.packed.__getitem__
            rows = [np.frombuffer(b"".join(map(ids_of, vocabulary.split(value or ""))), np.int32) for value in texts]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            values = np.concatenate([np.empty(0, np.int32), *rows])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            added = [ids]
            if check:
                pairs = zip(rows, texts, strict=True)
                same = [vocabulary.decode(row.tolist()) == (value or "").encode("utf-8") for row, value in pairs]
                added.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])
        # the worker goes on to tasks of other operators
        vocabulary.packed.forget()
        release()

    names = [_free(name, docs.columns) for name in ("ids", "round_trip")[: 1 + check]]
    schema = extended(docs.schema, **dict(zip(names, ("array<int>", "boolean")[: 1 + check], strict=True)))
    return docs.mapInArrow(run, schema)


def decode_table(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns of ``tokens`` plus ``decoded`` (binary), the bytes of the ids. Null ids: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path, pattern)
        for batch in small(batches):
            rows = batch.column(batch.schema.get_field_index(ids))
            decoded = (vocabulary.decode(row.values.to_pylist() if row.is_valid else []) for row in rows)
            data = pa.array(list(decoded), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], [*batch.schema.names, out])

    out = _free("decoded", tokens.columns)
    schema = extended(tokens.schema, **{out: "binary"})
    return tokens.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the decimal ids and of the decoded bytes.

    Encoding and decoding in one pass, without storing the ids. Rows with the
    same doc_id are kept apart; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path, pattern)
        of_piece = vocabulary.written.__getitem__
        for batch in small(batches):
            counts, encoded, decoded = [], [], []
            for value in batch.column(1).to_pylist():
                parts = list(map(of_piece, vocabulary.split(value or "")))
                joined = " ".join([ids for ids, _ in parts])
                counts.append(joined.count(" ") + 1 if joined else 0)
                encoded.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([data for _, data in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)

