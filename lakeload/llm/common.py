"""Helpers of the operators: stored intermediate tables, word hashes, mixing of 64-bit numbers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from lakeload.session import shared_folder

_TYPES = {
    "string": StringType(),
    "binary": BinaryType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "array<int>": ArrayType(IntegerType()),
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it again.

    The written table cuts the lineage and outlives lost executors. It is kept
    as long as the shared folder keeps it, since the result reads from it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key filter has at most 2 to this power bits (2 MB).
FILTER_BITS = 24


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """One number for the id and the text of a row."""
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), text_hash)


def bit_set(hashes: DataFrame) -> tuple[np.ndarray, int, int]:
    """A set of bits for the 64-bit numbers of the one column: the words, the bits a place has, the rows.

    A number's place is its upper bits. The set has at most ``2 ** FILTER_BITS``
    places; with very many numbers it holds more than these, never fewer.
    """
    spots, bits, size = _places(hashes)
    table = np.zeros(1 << max(0, bits - 6), np.int64)
    for row in _bit_words(spots).toLocalIterator():
        table[row["word"]] = row["bits"]
    return table, bits, size


def _places(hashes: DataFrame) -> tuple[DataFrame, int, int]:
    """The places ``p`` of the 64-bit numbers of the one column, the bits a place has, the rows."""
    size = hashes.count()
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, size))), 10, FILTER_BITS))
    return hashes.select(F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits).alias("p")), bits, size


def _bit_words(spots: DataFrame) -> DataFrame:
    """(word, bits): the words that have a bit set."""
    return spots.groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits")
    )


def key_filter(keys: DataFrame) -> Callable[[DataFrame, Column, str], DataFrame]:
    """Adds a column to rows that is true for every key of the one column of ``keys``, and for few others.

    Rows that fail it need no join with the keys, and so no shuffle. The test is
    a set of bits of bounded size, sent to the tasks as a small table; with very
    many keys it lets more rows pass, never fewer, so a join has to follow for
    the rows that pass. Python workers take no part in it.
    """
    spots, bits = _places(keys.select(F.xxhash64(keys.columns[0])))[:2]
    words = _bit_words(spots).select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))

    def mark(rows: DataFrame, key: Column, name: str) -> DataFrame:
        rows = rows.withColumn("__spot", F.shiftrightunsigned(F.xxhash64(key), 64 - bits))
        rows = rows.withColumn("__word", F.shiftright("__spot", 6)).join(F.broadcast(words), "__word", "left")
        found = F.expr("shiftright(__bits, cast(__spot & 63 AS int)) & 1") == 1
        return rows.withColumn(name, F.coalesce(found, F.lit(False))).drop("__word", "__spot", "__bits")

    return mark


#: Rows that a task holds as Python objects at a time.
ROWS = 500


def release() -> None:
    """Give back to the system what this worker has freed.

    A worker goes on to tasks of other operators, and what it keeps for itself
    meanwhile counts beside the memory of its executor.
    """
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # also trims what numpy and Python have freed


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about ``BATCH_BYTES``, where the session has no bound of its own.

    An executor and its worker hold a batch each, a task's whole input with
    Spark's 64 MB. What a batch holds does not change a result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``; freed memory is given back after each given batch."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)
        del batch
        release()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: str) -> str:
    """Lower case of A to Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def ascii_words(text: str | None) -> list[str]:
    """Words between ASCII white space."""
    if not text:
        return []
    if text.isascii():
        # str.split() also splits at 0x1C-0x1F, which are word characters here
        if not _ODD_SPACE.search(text):
            return text.split()
    return WORD.findall(text)


_ODD_SPACE = re.compile("[\x1c-\x1f]")


class WordHashes(dict):
    """64-bit hash of a word, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 150_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = value
        return value

    def of(self, words: Iterable[str], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, count)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its start and of its next element."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0x9FB21C651E98DF25) + right)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; empty if there are fewer words."""
    if len(hashes) < n:
        return hashes[:0]
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = chain(out, hashes[k : len(hashes) - n + 1 + k])
    return out


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column has it (case ignored)."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name += "_"
    return name


def extended(schema: StructType, **added: str) -> StructType:
    """``schema`` with further columns, given by name and type."""
    return StructType([*schema.fields, *(StructField(k, _TYPES[v]) for k, v in added.items())])
