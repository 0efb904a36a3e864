"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token (its bytes, to begin with) form a linked list. A
heap holds every adjacent pair that has a merge, by rank and then position. The
first pair is popped and merged, and the pairs on both its sides are pushed
anew, until the heap is empty; an entry whose pair has changed meanwhile is
skipped. The number of tokens is the number of symbols at the start less the
number of merges: no token identifier is looked up or emitted. A pre-token of n
bytes takes O(n log n) steps, so very long ones need no limit.

The file of the tokenizer says what is merged (pairs of symbols by rank), and
which added tokens are cut out of a text first; each of these counts as one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from lakeload.llm.common import extended, free_name, small
from lakeload.llm.splitting import splitter, library_class

# Fixed value: the split of byte-level tokenizers that use their built-in pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Counts of pre-tokens of up to so many characters are remembered, so many in each of two generations.
MEMO_CHARS = 40
MEMO_SIZE = 250_000

_POSITION = 40  # bits of a heap entry that hold the position
_SYMBOL = 24  # bits of a pair that hold its second symbol


def byte_letters() -> list[str]:
    """The printable character that byte-level files write for each byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Counter:
    """Counts the tokens of texts by a tokenizer file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        _check(spec, model)
        number = model["vocab"]
        self.start = [number[letter] for letter in byte_letters()]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {number[a] << _SYMBOL | number[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [number[a + b] for a, b in pairs]
        self.split = splitter(BYTE_LEVEL, library_class)
        added = sorted((t["content"] for t in spec.get("added_tokens", ()) if t["content"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo = _Memo(self)

    def merges(self, data: bytes) -> int:
        """The number of merges within one pre-token."""
        symbols = [self.start[b] for b in data]
        find, made, n = self.ranks.get, self.made, len(symbols)
        pairs = [a << _SYMBOL | b for a, b in zip(symbols, symbols[1:], strict=False)]
        now = [*map(find, pairs), None]  # rank of the pair that starts here
        heap = [rank << _POSITION | i for i, rank in enumerate(now) if rank is not None]
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done, mask = 0, (1 << _POSITION) - 1
        while heap:
            entry = heappop(heap)
            i, rank = entry & mask, entry >> _POSITION
            if now[i] != rank:
                continue  # stale: the pair that was pushed is no longer here
            done += 1
            j = after[i]
            k = after[j]
            symbols[i] = symbol = made[rank]
            after[i] = k
            now[j] = None
            if k < n:
                before[k] = i
                now[i] = rank = find(symbol << _SYMBOL | symbols[k])
                if rank is not None:
                    heappush(heap, rank << _POSITION | i)
            else:
                now[i] = None
            h = before[i]
            if h >= 0:
                now[h] = rank = find(symbols[h] << _SYMBOL | symbol)
                if rank is not None:
                    heappush(heap, rank << _POSITION | h)
        return done

    def count(self, text: str) -> int:
        """The number of tokens of a text."""
        if self.added is None or not self.added.search(text):
            return sum(map(self.memo.__getitem__, self.split(text)))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, self.split(part))) for part in parts)


def _check(spec: dict, model: dict) -> None:
    """Refuse a file that asks for anything this counting does not do."""
    before = spec.get("pre_tokenizer") or {}
    plain = {
        "a byte-level pre-tokenizer with its own pattern": before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space"),
        "no normalizer": not spec.get("normalizer"),
        "byte-pair merges without dropout, affixes or ignored merges": model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and not model.get("ignore_merges"),
        "added tokens that stand for themselves": not any(
            t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")
        ),
    }
    wrong = [need for need, held in plain.items() if not held]
    if wrong:
        raise ValueError(f"the tokenizer file must have {'; '.join(wrong)}")


class _Memo(dict):
    """Counts of pre-tokens seen before, in two generations."""

    def __init__(self, counter: Counter) -> None:
        super().__init__()
        self.counter = counter
        self.older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        count = self.older.get(piece)
        if count is None:
            data = piece.encode("utf-8")
            count = len(data) - self.counter.merges(data)
            if len(piece) > MEMO_CHARS:
                return count
        if len(self) >= MEMO_SIZE:
            self.older = dict(self)
            self.clear()
        self[piece] = count
        return count


@lru_cache(maxsize=2)
def load_counter(path: str) -> Counter:
    with open(path, encoding="utf-8") as file:
        return Counter(json.load(file))


def count_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``n_bytes`` and ``n_tokens`` (long) of the whole text.

    ``path`` names the tokenizer file; every executor needs it under that name.
    A null or empty text has no bytes and no tokens. Every row is counted by
    itself, repeated ones too, and nothing is shuffled. Where a column of that
    name is there already, the new one gets an underscore.
    """
    names = [free_name(name, docs.columns) for name in ("n_bytes", "n_tokens")]
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(path)
        for rows in small(batches):
            texts = [value or "" for value in rows.column(place).to_pylist()]
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
            counts = [pa.array(sizes, pa.int64()), pa.array(map(counter.count, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *counts], [*rows.schema.names, *names])

    return docs.mapInArrow(run, extended(docs.schema, **dict.fromkeys(names, "bigint")))
