"""Language model scores from a weighted backoff automaton.

States are the word histories seen in training, the empty one included. A state
has an arc for every word seen after it, weighted with log10 of its smoothed
probability, and a failure arc to the history without its first word:

    p(w | h) = (c(hw) + a p(w | h')) / (c(h) + a),   failure weight a / (c(h) + a)

(Dirichlet smoothing; the probabilities after every history sum to one). The
empty history has an arc for every word: (c + 1) / (N + V + 1). A text is read
from left to right: the state is the longest known history; where it lacks the
arc of the next word, failure weights are added until a state has it.

The automaton grows with the corpus, so no task holds it whole. The scan is cut
into blocks of documents, and a block only needs the arcs of its own n-grams:

1. Every block sends its distinct n-grams (64-bit hashes, sorted and packed) with
   their training counts to the shards of the hash space.
2. A shard adds up the counts and answers every block in the block's own order.
   A frequent n-gram is one number per block, so no shard is hot.
3. Documents and answers meet by block. The part of the automaton that the block
   needs is built, and all its texts are traversed at once.

Blocks follow the scan, so the table has to give the same rows in the same order
each time it is read, as files do. ``order`` is the longest n-gram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import WordHashes, ascii_words, chain, lower_ascii, stored

ORDER = 3
#: Weight of the shorter history, in counts.
CONCENTRATION = 40.0
#: Characters of a block, and n-grams that a shard gets in the mean.
BLOCK_CHARS = 4_000_000
SHARD_NGRAMS = 1_000_000
#: Words whose hashes a task remembers.
WORDS = 400_000
_END, _START = np.uint64(0x1D8AF066B1A2C3D5), np.uint64(0x7F4A7C159E3779B9)


def held_out_id(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class Block:
    """N-grams of some documents: per order the distinct keys, and the place of each position in them."""

    def __init__(self, doc_ids: list[int | None], texts: list[str | None], order: int, hashes: WordHashes) -> None:
        arrays = []
        for text in texts:
            words = ascii_words(lower_ascii(text or ""))
            arrays.append(np.r_[_START, hashes.of(words, len(words)), _END])
        lengths = np.array([len(a) for a in arrays], np.int64)
        self.doc_ids = doc_ids
        self.held_out = np.array([held_out_id(i) for i in doc_ids], bool)
        self.starts = np.cumsum(lengths) - lengths  # of START in the joined tokens
        self.tokens = lengths - 1
        tokens = np.concatenate(arrays)
        training = np.repeat(~self.held_out, lengths)
        place = np.arange(len(tokens)) - np.repeat(self.starts, lengths)
        self.keys, self.counts, self.at = [], [], []
        grams = tokens
        for n in range(1, order + 1):
            if n > 1:
                # the n-gram that ends here: the shorter one that ends at the word before, and this word
                grams = np.r_[grams[:1], chain(grams[:-1], tokens[1:])]
            real = np.flatnonzero(place >= n - 1)
            keys, inverse = np.unique(grams[real], return_inverse=True)
            self.keys.append(keys)
            self.counts.append(np.bincount(inverse, training[real], len(keys)).astype(np.uint32))
            at = np.full(len(tokens), -1, np.int32)
            at[real] = inverse
            self.at.append(at)
        self.place = place


def score_block(
    block: Block, totals: list[np.ndarray], tokens: int, types: int, concentration: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and model score of every document of the block."""
    # a block may have no n-gram of an order at all
    count = [t.astype(np.float64)[a] if len(t) else np.zeros(len(a)) for t, a in zip(totals, block.at, strict=True)]
    for c, a in zip(count, block.at, strict=True):
        c[a < 0] = 0
    word = np.flatnonzero(block.place >= 1)
    # arcs of the empty history
    chance = (count[0] + 1) / (tokens + types + 1)
    base = np.log10(chance)
    arcs = [base]
    fails = [np.zeros_like(base)]
    for n in range(1, len(count)):
        # history of n words before each position: its state exists if it was seen in training
        history = np.r_[0.0, count[n - 1][:-1]]
        state = history > 0
        lower = chance
        chance = np.where(state, (count[n] + concentration * lower) / (history + concentration), lower)
        arcs.append(np.where(state & (count[n] > 0), np.log10(chance), -np.inf))
        fails.append(np.where(state, np.log10(concentration / (history + concentration)), 0.0))
    # all positions at once: start in the longest state, fail until there is an arc
    total = np.zeros_like(base)
    open_ = word
    for n in range(len(arcs) - 1, -1, -1):
        found = np.isfinite(arcs[n][open_])
        total[open_[found]] += arcs[n][open_[found]]
        open_ = open_[~found]
        total[open_] += fails[n][open_]
    known = np.zeros(len(base), np.int64)
    known[word] = count[0][word] > 0
    start = block.starts
    base[block.place == 0] = 0
    return np.add.reduceat(known, start), np.add.reduceat(base, start), np.add.reduceat(total, start)


def _pack(values: np.ndarray, sort: bool = False) -> bytes:
    """Numbers as compressed bytes, by place value; sorted ones as differences."""
    if sort:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type, sort: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if sort else values


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(number, ids, texts) of blocks in scan order, whatever the size of the batches."""
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text or "") + 8
            if size >= BLOCK_CHARS:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def _requests(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """(n, shard, block, keys, counts): the distinct n-grams of every block by shard."""
    shift = np.uint64(65 - shards.bit_length())  # shards is a power of two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(WORDS)
        for number, ids, texts in _blocks(batches):
            block = Block(ids, texts, order, hashes)
            for n in range(order):
                keys, counts = block.keys[n], block.counts[n]
                shard = (keys >> shift).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
                used = np.unique(shard)
                bounds = np.r_[np.searchsorted(shard, used), len(keys)]
                parts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), n, np.int32)),
                        pa.array(used),
                        pa.array(np.full(len(used), number, np.int64)),
                        pa.array([_pack(keys[p], True) for p in parts], pa.binary()),
                        pa.array([_pack(counts[p]) for p in parts], pa.binary()),
                    ],
                    ["n", "shard", "block", "keys", "counts"],
                )

    return docs.mapInArrow(run, "n int, shard bigint, block bigint, keys binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(n, shard, block, totals, types, tokens): corpus counts in the order of the request.

    The row of block -1 has the number of types and tokens of the shard instead.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, shard = int(frame["n"].iloc[0]), int(frame["shard"].iloc[0])
        keys = [_unpack(k, np.uint64, True) for k in frame["keys"]]
        counts = np.concatenate([_unpack(c, np.uint32) for c in frame["counts"]])
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, counts, len(every)).astype(np.uint64)
        own = totals[every != _START] if n == 0 else totals
        rows, at = [(n, shard, -1, None, int((own > 0).sum()), int(own.sum()))], 0
        for block, part in zip(frame["block"], keys, strict=True):
            rows.append((n, shard, block, _pack(totals[inverse[at : at + len(part)]]), 0, 0))
            at += len(part)
        return pd.DataFrame(rows, columns=["n", "shard", "block", "totals", "types", "tokens"])

    schema = "n int, shard bigint, block bigint, totals binary, types bigint, tokens bigint"
    return requests.groupBy("n", "shard").applyInPandas(run, schema)


def _packed_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, texts): the documents of every block, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in _blocks(batches):
            table = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            data = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([data], pa.binary())], ["block", "docs"])

    return docs.mapInArrow(run, "block bigint, docs binary")


def score(docs: DataFrame, order: int = ORDER, concentration: float = CONCENTRATION) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text, modulo 7, is 2 are held out; the others
    train. A null text is empty and has one token, its end; a null id counts as
    an empty text. Repeated rows count as often as they occur.
    """
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, size / 6 / SHARD_NGRAMS)))))
    answers = stored(_answers(_requests(docs, order, shards)), "counts")
    row = answers.where("block = -1 AND n = 0").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = row[0] or 0, row[1] or 0

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=_COLUMNS)
        data = zstandard.ZstdDecompressor().decompress(left["docs"].iloc[0])
        table = pa.ipc.open_stream(data).read_all()
        block = Block(table["id"].to_pylist(), table["text"].to_pylist(), order, WordHashes(WORDS))
        right = right.sort_values(["n", "shard"])
        totals = []
        for n in range(order):
            parts = [_unpack(t, np.uint64) for t in right.loc[right["n"] == n, "totals"]]
            totals.append(np.concatenate([np.empty(0, np.uint64), *parts]))
            if len(totals[n]) != len(block.keys[n]):
                raise RuntimeError("the table gave other rows when it was read again")
        known, base, full = score_block(block, totals, tokens, types, concentration)
        return pd.DataFrame(
            {
                "doc_id": pd.array(block.doc_ids, "Int64"),
                "held_out": block.held_out,
                "n_tokens": block.tokens,
                "n_known": known,
                "train_tokens": tokens,
                "base_score": base,
                "score": full,
            }
        )

    asked = answers.where("block >= 0").select("block", "n", "shard", "totals")
    met = _packed_blocks(docs).groupBy("block").cogroup(asked.groupBy("block"))
    return met.applyInPandas(run, _SCHEMA)


_COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_SCHEMA = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)
