"""Training-order materialisation: sequences in fixed-stride shards, in a keyed random order.

1. The documents of a table, in the order of its scan, form one stream of
   tokens with an end token after each. Only the number of tokens per scan
   partition reaches the driver, which gives every partition its place.
2. The stream is cut into sequences of ``length`` tokens; padding fills the last.
   Sequence i gets slot P(i), where P is a keyed permutation of 0..n-1: a Feistel
   network over the next power of four, walked along its cycles until it falls
   below n. No table of the order exists, and P can be inverted.
3. Slots are cut into shards of equal size. Every scan task sends each shard one
   packed block of its pieces; a shard is written by one task, as a file in
   which slot s lies at (s - first) * length. A file is written under another
   name and then renamed. A shard that is there in full is not written again, so
   a stopped run goes on where it was; readers can seek to any slot.

Tokens are those of a column of ids, or the ids of the text by a rank file
(encoded once, to count; the bytes of every token are stored, a fraction of the
ids, and the text cut by them gives the ids again to pack), or else the bytes of the text: 0 to 244 are bytes that UTF-8
can hold, 255 ends a document, 254 pads. A null text or list has no tokens, only
an end; a null id is given as -1.
The table has to give the same rows in the same order each time it is read, as
files do; if it does not, the shards do not come out full and the run fails.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lakeload.llm.common import ROWS, small
from lakeload.session import shared_folder

LENGTH = 2048
SHARD_SEQUENCES = 8192
END, PAD = 255, 254
ROUNDS = 4


@dataclass(frozen=True)
class Tokens:
    """What a token is: the column, its bytes as stored (little-endian), and the two special ids.

    ``column`` holds an array of ids of less than ``end`` and ``pad``; without
    it, the tokens are the ids of ``text`` by the rank file ``ranks``, each match of
    ``pattern`` by itself, or else its bytes. Every executor needs the file.
    """

    column: str | None = None
    width: int = 1
    end: int = END
    pad: int = PAD
    ranks: str | None = None
    pattern: str = ""
    #: A shared folder for the lengths of the tokens by ``ranks``, between counting and packing.
    lengths: str | None = None

    def _values(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the rows, and how many each row has."""
        kind = f"<u{self.width}"
        if self.column is not None:
            found = values.flatten().to_numpy(zero_copy_only=False)
            if len(found) and not 0 <= found.min() <= found.max() < min(self.end, self.pad):
                raise ValueError(f"token ids must be from 0 to less than {min(self.end, self.pad)}")
            return found.astype(kind), values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        texts = [value or "" for value in values.to_pylist()]
        if self.ranks is None:
            parts = [np.frombuffer(text.encode("utf-8"), np.uint8) for text in texts]
        else:
            encode = _encoding(self.ranks, self.pattern).encode_to_numpy
            parts = [_narrow(encode(text), kind) for text in texts]
        return np.concatenate([np.empty(0, kind), *parts]).astype(kind), np.array([len(p) for p in parts], np.int64)

    def count(self, values: pa.Array) -> int:
        """Tokens of documents with their ends."""
        return int(self._values(values)[1].sum()) + len(values)

    def stream(self, values: pa.Array, stored: Iterator[np.ndarray] | None = None) -> tuple[bytes, np.ndarray]:
        """Tokens of documents with their ends, and the byte where each document begins.

        ``stored`` gives the lengths of the tokens of each document.
        """
        found, lengths = self._values(values) if stored is None else self._cut(values, stored)
        ends = np.cumsum(lengths + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, self.end, f"<u{self.width}")
        own = np.ones(len(out), bool)
        own[ends - 1] = False
        out[own] = found
        return out.tobytes(), (ends - lengths - 1).astype(np.int64) * self.width

    def _cut(self, values: pa.Array, stored: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_values``, by the lengths that were stored when the tokens were counted."""
        find, kind, parts, counts = _lookup(self.ranks), f"<u{self.width}", [], []
        for start in range(0, len(values), ROWS):
            texts = [(text or "").encode("utf-8") for text in values.slice(start, ROWS).to_pylist()]
            lengths = list(islice(stored, len(texts)))
            if [int(one.sum(dtype=np.int64)) for one in lengths] != [len(text) for text in texts]:
                raise RuntimeError(_CHANGED)
            counts += [len(one) for one in lengths]
            parts.append(_narrow(find.ids(b"".join(texts), np.concatenate(lengths)), kind))
        return np.concatenate([np.empty(0, kind), *parts]), np.array(counts, np.int64)

    def padding(self, count: int) -> np.ndarray:
        one = np.frombuffer(self.pad.to_bytes(self.width, "little"), np.uint8)
        return np.tile(one, count)


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> object:
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


class _Lookup:
    """Ranks of many tokens at once, given as one run of bytes and the length of each.

    Tokens of up to eight bytes are numbers in small hash tables; a token whose
    slot is taken goes to the next table. The rest, and longer ones, are looked up singly.
    """

    BITS = 18
    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        short = [token for token in ranks if 0 < len(token) <= 8]
        self.value = np.array([int.from_bytes(token, "little") for token in short] or [0], np.uint64)
        self.size = np.array([len(token) for token in short] or [0], np.uint64)
        self.rank = np.array([ranks[token] for token in short] or [0], np.int64)
        self.masks = np.array([256**k - 1 for k in range(9)], np.uint64)
        self.tables, left = [], np.arange(len(short))
        for factor in self.FACTORS:
            table = np.zeros(1 << self.BITS, np.int32)
            places, first = np.unique(self._place(self.value[left], self.size[left], factor), return_index=True)
            table[places] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def _place(self, value: np.ndarray, size: np.ndarray, factor: int) -> np.ndarray:
        x = (value ^ (value >> np.uint64(29))) + size
        return (x * np.uint64(factor)) >> np.uint64(64 - self.BITS)

    def ids(self, data: bytes, lengths: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lengths, dtype=np.int64)
        starts = ends - lengths
        windows = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
        size = np.minimum(lengths, 8).astype(np.uint64)
        value = windows[starts] & self.masks[size]
        out, todo = np.empty(len(lengths), np.int64), np.flatnonzero(lengths <= 8)
        rest = [np.flatnonzero(lengths > 8)]
        for table, factor in zip(self.tables, self.FACTORS, strict=True):
            at = table[self._place(value[todo], size[todo], factor)]
            same = (self.value[at] == value[todo]) & (self.size[at] == size[todo])
            out[todo[same]] = self.rank[at[same]]
            todo = todo[~same]
        for k in np.concatenate([todo, *rest]).tolist():
            rank = self.ranks.get(data[starts[k] : ends[k]])
            if rank is None:
                raise RuntimeError(_CHANGED)
            out[k] = rank
        return out


@lru_cache(maxsize=2)
def _lookup(path: str) -> _Lookup:
    return _Lookup(_ranks(path))


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    """The bytes that each token has, by its rank."""
    ranks = _ranks(path)
    out = np.zeros(max(ranks.values(), default=0) + 1, np.uint32)
    for token, rank in ranks.items():
        out[rank] = len(token)
    return out.astype(np.min_scalar_type(int(out.max())))


def _narrow(ids: np.ndarray, kind: str) -> np.ndarray:
    if len(ids) and ids.max() > np.iinfo(kind).max:
        raise OverflowError(f"a token id is larger than {kind} can hold")
    return ids.astype(kind)


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0..count-1."""

    count: int
    key: int

    @property
    def half(self) -> int:
        """Bits of half a block: the smallest block of an even number of bits that holds all."""
        return max(1, (max(self.count - 1, 1).bit_length() + 1) // 2)

    def _round(self, right: np.ndarray, number: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = right + np.uint64((self.key + number * 0x9E3779B97F4A7C15) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(31))) & np.uint64(2**self.half - 1)

    def _block(self, x: np.ndarray, rounds: range) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64(2**self.half - 1)
        left, right = x >> bits, x & mask
        backwards = rounds.step < 0
        for number in rounds:
            if backwards:
                left, right = right ^ self._round(left, number), left
            else:
                left, right = right, left ^ self._round(right, number)
        return (left << bits) | right

    def _walk(self, x: np.ndarray, rounds: range) -> np.ndarray:
        out = self._block(np.asarray(x, np.uint64), rounds)
        # a block holds less than four times the count, so walks are short
        while (over := out >= self.count).any():
            out[over] = self._block(out[over], rounds)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, range(ROUNDS))

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, range(ROUNDS - 1, -1, -1))


def _plan(docs: DataFrame, tokens: Tokens) -> dict[int, int]:
    """Bytes before each scan partition; one number a partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if tokens.lengths is None:
            n = sum(tokens.count(batch.column(1)) for batch in small(batches))
        else:
            n = _count_and_store(small(batches), tokens, part)
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [n * tokens.width]})

    rows = [row for row in docs.mapInArrow(run, "part bigint, n bigint").collect() if row["n"]]
    starts, at = {}, 0
    for row in sorted(rows, key=lambda r: r["part"]):
        starts[row["part"]] = at
        at += row["n"]
    starts[-1] = at
    return starts


def _count_and_store(batches: Iterator[pa.RecordBatch], tokens: Tokens, part: int) -> int:
    """Tokens of a partition with their ends; the lengths of the tokens are written, a block for each batch."""
    encode = _encoding(tokens.ranks, tokens.pattern).encode_to_numpy
    sizes, compress, n = _token_bytes(tokens.ranks), zstandard.ZstdCompressor(level=3).compress, 0
    store, folder = fs.FileSystem.from_uri(tokens.lengths if ":" in tokens.lengths else f"file://{tokens.lengths}")
    store.create_dir(folder, recursive=True)
    attempt = f"{folder}/.{part}-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(attempt) as file:
        for batch in batches:
            lengths = [sizes[encode(text or "")] for text in batch.column(1).to_pylist()]
            counts = np.array([len(one) for one in lengths], np.int64)
            data = compress(np.concatenate([sizes[:0], *lengths]).tobytes())
            file.write(np.array([len(counts), len(data)], np.int64).tobytes() + counts.tobytes() + data)
            n += int(counts.sum()) + len(counts)
    store.move(attempt, f"{folder}/{part}")
    return n


def _stored_lengths(tokens: Tokens, part: int) -> Iterator[np.ndarray]:
    """The lengths of the tokens of each document of a partition, in order."""
    kind, expand = _token_bytes(tokens.ranks).dtype, zstandard.ZstdDecompressor().decompress
    store, folder = fs.FileSystem.from_uri(tokens.lengths if ":" in tokens.lengths else f"file://{tokens.lengths}")
    with store.open_input_stream(f"{folder}/{part}") as file:
        while head := file.read(16):
            rows, size = np.frombuffer(head, np.int64).tolist()
            counts = np.frombuffer(file.read(8 * rows), np.int64)
            data = file.read(size)
            found = np.frombuffer(expand(data) if counts.sum() else b"", kind)
            yield from np.split(found, np.cumsum(counts)[:-1]) if rows else ()


def write_shards(
    docs: DataFrame,
    folder: str,
    key: int = 1,
    length: int = LENGTH,
    shard_sequences: int = SHARD_SEQUENCES,
    tokens: Tokens = Tokens(),
) -> DataFrame:
    """Write the shards and return (sequence, slot, shard, place, crc32, doc_ids) of every sequence.

    ``place`` is the offset in the shard's file, ``doc_ids`` are the documents
    that begin in the sequence. Shards are written when the result is computed.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", tokens.column or "text")
    if tokens.column is None and tokens.ranks is not None:
        tokens = replace(tokens, lengths=shared_folder(spark, "lengths"))
    length *= tokens.width  # from here on all is counted in bytes
    starts = _plan(docs, tokens)
    total = starts.pop(-1)
    count = -(-total // length)
    if not count:
        return spark.createDataFrame([], _SCHEMA)
    order = Permutation(count, key)
    places = spark.sparkContext.broadcast(starts)  # one number a partition

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = places.value.get(part, -1)
        stored = None if tokens.lengths is None else _stored_lengths(tokens, part)
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in small(batches, PACKED):
            if not batch.num_rows:
                continue
            if at < 0:
                raise RuntimeError(_CHANGED)
            data, begins = tokens.stream(batch.column(1), stored)
            doc_ids = np.array([-1 if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            first, last = at // length, (at + len(data) - 1) // length
            sequences = np.arange(first, last + 1)
            slots = order.slot(sequences)
            shard = slots // shard_sequences
            # sequence and offset of the first token of each piece, and its end in the data
            bounds = np.clip(np.r_[sequences, last + 1] * length - at, 0, len(data))
            owner = (at + begins) // length - first
            by_piece = np.searchsorted(owner, np.arange(len(sequences) + 1))
            rows = []
            for target in np.unique(shard):
                chosen = np.flatnonzero(shard == target)
                head = np.empty((len(chosen), 5), np.int64)
                head[:, 0], head[:, 1] = sequences[chosen], slots[chosen]
                head[:, 2] = at + bounds[chosen] - sequences[chosen] * length
                head[:, 3] = bounds[chosen + 1] - bounds[chosen]
                head[:, 4] = by_piece[chosen + 1] - by_piece[chosen]
                body = b"".join(data[bounds[c] : bounds[c + 1]] for c in chosen)
                ids = np.concatenate([doc_ids[by_piece[c] : by_piece[c + 1]] for c in chosen])
                rows.append((int(target), head.tobytes(), ids.tobytes(), compress(body)))
            at += len(data)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["shard", "head", "ids", "body"]
            )

    blocks = docs.mapInArrow(pack, "shard bigint, head binary, ids binary, body binary")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["shard"].iloc[0])
        first = number * shard_sequences
        held = min(shard_sequences, count - first)
        grid = tokens.padding(held * length // tokens.width)
        empty = np.ones(len(grid), bool)
        begun: dict[int, list[int]] = {}
        expand = zstandard.ZstdDecompressor()
        for head, ids, body in zip(frame["head"], frame["ids"], frame["body"], strict=True):
            rows = np.frombuffer(head, np.int64).reshape(-1, 5)
            data = np.frombuffer(expand.decompress(body, max_output_size=int(rows[:, 3].sum()) or 1), np.uint8)
            doc_ids, d, i = np.frombuffer(ids, np.int64).tolist(), 0, 0
            for sequence, slot, offset, size, documents in rows.tolist():
                start = (slot - first) * length + offset
                if not empty[start : start + size].all():
                    raise RuntimeError(_CHANGED)
                grid[start : start + size] = data[d : d + size]
                empty[start : start + size] = False
                begun.setdefault(sequence, []).append((offset, doc_ids[i : i + documents]))
                d, i = d + size, i + documents
        # only the sequence of the end of the stream is not full
        rest = count * length - total if order.slot(np.array([count - 1]))[0] // shard_sequences == number else 0
        if empty.sum() != rest:
            raise RuntimeError(_CHANGED)
        _put(f"{folder}/shard-{number:08d}.bin", grid.tobytes())
        sequences = np.array(sorted(begun), np.int64)
        slots = order.slot(sequences)
        return pd.DataFrame(
            {
                "sequence": sequences,
                "slot": slots,
                "shard": number,
                "place": (slots - first) * length,
                "crc32": [zlib.crc32(grid[(s - first) * length :][:length].tobytes()) for s in slots],
                "doc_ids": [[i for _, part in sorted(begun[s]) for i in part] for s in sequences.tolist()],
            }
        )

    return blocks.groupBy("shard").applyInPandas(write, _SCHEMA)


_CHANGED = "the table did not come in the same rows and partitions as when it was counted"
#: Rows that are packed into blocks at once.
PACKED = 4000
_SCHEMA = "sequence bigint, slot bigint, shard bigint, place bigint, crc32 bigint, doc_ids array<bigint>"


def _put(path: str, data: bytes) -> None:
    """Write a file unless it is there in full; a task that is run twice does no harm."""
    store, name = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    folder, _, base = name.rpartition("/")
    info = store.get_file_info(name)
    if info.type == fs.FileType.File and info.size == len(data):
        with store.open_input_stream(name) as file:
            if zlib.crc32(file.read()) == zlib.crc32(data):
                return
    store.create_dir(folder, recursive=True)
    attempt = f"{folder}/.{base}-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(attempt) as file:
        file.write(data)
    store.move(attempt, name)


def read_slots(
    folder: str,
    first: int,
    count: int,
    length: int = LENGTH,
    shard_sequences: int = SHARD_SEQUENCES,
    width: int = 1,
) -> np.ndarray:
    """Sequences at ``first`` and the following slots, as rows of tokens; reads only these bytes."""
    store, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    rows = []
    while count > 0:
        shard, offset = divmod(first, shard_sequences)
        take = min(count, shard_sequences - offset)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
            file.seek(offset * length * width)
            rows.append(np.frombuffer(file.read(take * length * width), f"<u{width}").reshape(-1, length))
        first, count = first + take, count - take
    return np.concatenate(rows) if rows else np.empty((0, length), f"<u{width}")
