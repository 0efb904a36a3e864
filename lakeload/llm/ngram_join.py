"""N-gram Jaccard self-join of texts by MinHash banding, verified on full n-gram sets.

Words are runs of characters other than ASCII white space, in lower case; the
n-grams of a text are its distinct runs of five words (a shorter text has one,
all its words). Two texts are linked if the Jaccard similarity of their n-gram
sets is 0.8 or more.

1. One pass gives every row a 128-bit digest of its n-gram set and its band
   hashes. Rows with equal sets form a class, so copies cost one row from here.
2. Band hashes are shuffled. Every class points to the smallest class of each
   of its buckets: as many edges as rows, never all pairs of a bucket.
3. Components of these edges are the candidate groups. Only their classes fetch
   their n-gram sets. Large groups are cut into blocks, and every pair of blocks
   is compared by a task of its own, as products of 0/1 matrices.
4. Tasks return link counts and a spanning forest instead of pairs. Components
   of the forests are the groups that are returned.

A null or wordless text has no n-grams and is linked to nothing; its class is
its own id. Rows that repeat an id count as rows of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.llm.common import WordHashes, ascii_words, chain, key_filter, mix, ngrams, release, row_key, small, stored
from lakeload.llm.components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
#: Bounds of one comparison task: classes on a side, and n-grams on a side.
BLOCK_CLASSES = 256
BLOCK_NGRAMS = 1_000_000
_COLUMNS = 4096


def bands_for(similarity: float, recall: float, noise: float = 0.02) -> tuple[int, int]:
    """Fewest hashes as (bands, rows per band) that find a pair of ``similarity`` with ``recall``.

    A pair of less than a third of ``similarity`` may collide with at most the
    probability ``noise``; more rows per band keep such pairs out.
    """
    best = None
    for rows in range(1, 17):
        hit = similarity**rows
        if hit >= 1:
            return 1, rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - hit))
        stray = 1 - (1 - (similarity / 3) ** rows) ** bands
        if stray <= noise * 10 and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
        if stray <= noise:
            break
    return best or (bands, rows)


def ngram_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    found = ascii_words((text or "").lower())
    if not found:
        return np.empty(0, np.uint64)
    values = hashes.of(found, len(found))
    if len(values) < words:
        return chain(ngrams(values, len(values)), np.array([len(values)], np.uint64))
    return np.unique(ngrams(values, words))


def _band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    least = np.empty(bands * rows, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            # multiply-shift by an odd constant on well mixed hashes
            least[k] = (grams * _FACTORS[k] + _OFFSETS[k]).min()
    out = mix(np.arange(bands, dtype=np.uint64), 77)
    least = least.reshape(bands, rows)
    for r in range(rows):
        out = chain(out, least[:, r])
    return out


_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 2**63, 4096, dtype=np.uint64)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, node (digest of its set), n_grams, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            nodes, sizes, found = [], [], []
            for text in batch.column(2).to_pylist():
                grams = ngram_set(text, words, hashes)
                sizes.append(len(grams))
                nodes.append(_digest(grams) if len(grams) else None)
                found.append(_band_hashes(grams, bands, rows).view(np.int64) if len(grams) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(nodes, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "node", "n_grams", "bands"],
            )

    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id bigint, text_hash bigint, node binary, n_grams bigint, bands array<bigint>"
    return narrow.mapInArrow(run, schema)


def _block_plan(groups: DataFrame) -> DataFrame:
    """Members (node, root, ...) with the comparison tasks they take part in: part, other, side."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g"))
    sizes = sizes.withColumn(
        "blocks",
        F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("g") / BLOCK_NGRAMS)).cast("int"),
    )
    # small groups share a task: as many packs as their n-grams fill
    packs = sizes.where("blocks = 1").agg(F.coalesce(F.sum("g"), F.lit(0)).alias("g"))
    packs = packs.select(F.greatest(F.lit(1), F.ceil(F.col("g") * 4 / BLOCK_NGRAMS)).cast("int").alias("packs"))
    members = groups.join(sizes.select("root", "blocks"), "root").crossJoin(F.broadcast(packs))  # one row
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.select(
        "node",
        "root",
        "own",
        F.least("own", "o").alias("i"),
        F.greatest("own", "o").alias("j"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.col("packs")))
        .otherwise(F.xxhash64("root", F.least("own", "o"), F.greatest("own", "o")))
        .alias("task"),
        "copies",
        "rep_id",
        "rep_hash",
    )


def _compare(frame: pd.DataFrame, similarity: float) -> Iterator[tuple[bytes, int, bytes]]:
    """Links and forest of the classes of one group and pair of blocks: (node, links, root)."""
    sets = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
    nodes, copies, own = list(frame["node"]), frame["copies"].to_numpy(), frame["own"].to_numpy()
    n = len(sets)
    if n < 2:
        return
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    del order
    # n-grams in order, numbered; those of one class alone are left out, and the others numbered anew
    column = np.cumsum(np.r_[False, values[1:] != values[:-1]], dtype=np.int32)
    del values
    shared = np.bincount(column)[column] > 1
    column, owners = column[shared], owners[shared]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]][: len(column)], dtype=np.int32)
    common = np.zeros((n, n), np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + _COLUMNS + 1, _COLUMNS))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        if part.start == part.stop:
            continue
        grid = np.zeros((n, _COLUMNS), np.float32)
        grid[owners[part], column[part] - k * _COLUMNS] = 1
        common += grid @ grid.T
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    i, j = frame["i"].iloc[0], frame["j"].iloc[0]
    if i != j:
        linked &= own[:, None] != own[None, :]
    links = linked @ copies
    # spanning forest by breadth-first search over the rows of the matrix
    root = np.full(n, -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], front = start, [start]
        while front:
            reached = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
            root[reached] = start
            front = list(reached)
    for k in range(n):
        if links[k]:
            yield nodes[k], int(links[k]), nodes[root[k]]


def _verified(docs: DataFrame, tasks: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, links, other) per comparison task."""
    wanted = tasks.select("rep_id", "rep_hash", "node").distinct()
    texts = docs.select(
        F.coalesce("doc_id", F.lit(-1)).alias("rep_id"), F.xxhash64("text").alias("rep_hash"), "text"
    )
    # most texts have no candidate and are left where they are
    mark = key_filter(wanted.select(row_key(F.col("rep_id"), F.col("rep_hash"))))
    texts = mark(texts, row_key(F.col("rep_id"), F.col("rep_hash")), "maybe").where("maybe").drop("maybe")
    texts = texts.join(wanted, ["rep_id", "rep_hash"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            nodes, grams = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = ngram_set(text, words, hashes)
                if _digest(found) == node:  # another text with the same id and hash is passed over
                    nodes.append(node)
                    grams.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(grams, pa.binary())], ["node", "grams"]
            )

    found = texts.select("node", "text").mapInArrow(sets, "node binary, grams binary").dropDuplicates(["node"])
    full = tasks.select("task", "root", "i", "j", "own", "node", "copies").join(found, "node")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(["root", "i", "j"], sort=False):
            out.extend(_compare(part, similarity))
        release()
        return pd.DataFrame(out, columns=["node", "links", "other"])

    schema = T.StructType(
        [T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("other", T.BinaryType())]
    )
    return full.groupBy("task").applyInPandas(compare, schema)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, class_id, n_links, keeps.

    ``class_id`` is the smallest doc_id of all rows that chains of links
    connect, ``n_links`` the number of other rows of similarity ``similarity``
    or more, ``keeps`` true for the rows whose id and text are those of the
    class representative (see ``one_per_class``).
    """
    docs = docs.select("doc_id", "text")
    bands, rows = bands_for(similarity, recall)
    marks = stored(signatures(docs, words, bands, rows), "signatures")
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("text_hash").alias("hash")))
    known = marks.where(F.col("node").isNotNull())
    classes = stored(
        known.groupBy("node").agg(
            rep.alias("rep"),
            F.count("*").alias("copies"),
            F.first("n_grams").alias("n_grams"),
            F.min("doc_id").alias("least_id"),
        ),
        "classes",
    )
    # one row per class and band; the smallest class of a bucket stands for it
    keys = known.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    heads = keys.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    star = keys.join(heads.select("band", "head"), "band").where(F.col("node") != F.col("head"))
    candidates = components(star, "node", "head")
    groups = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root")).distinct()
    groups = groups.join(classes, "node").select(
        "node", "root", "copies", "n_grams", F.col("rep.id").alias("rep_id"), F.col("rep.hash").alias("rep_hash")
    )
    tasks = stored(_block_plan(stored(groups, "groups")), "tasks")
    found = stored(_verified(docs, tasks, words, similarity), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(found.select("node", "other"), "node", "other")
    labelled = classes.join(final, "node", "left").join(links, "node", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "node"))
    per_root = labelled.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min("rep").alias("root_rep"))
    labels = labelled.join(per_root, "root").select(
        "node", "class_id", "root_rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = marks.join(labels, "node", "left")
    own = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("text_hash").alias("hash"))
    return out.select(
        "doc_id",
        "text_hash",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce(own == F.col("root_rep"), F.lit(True)).alias("keeps"),
    )


def one_per_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that represent their class; of repeated rows one stays.

    Rows without words are no near-duplicates of anything, and all stay. Rows
    that no other row is linked to are not shuffled.
    """
    linked = classes.where("n_links > 0").groupBy("doc_id", "text_hash").agg(F.bool_or("keeps").alias("__keeps"))
    linked = linked.select(F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.col("text_hash").alias("__hash"), "__keeps")
    linked = stored(linked, "linked")
    mark = key_filter(linked.select(row_key(F.col("__id"), F.col("__hash"))))
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-1)), "__hash": F.xxhash64("text")})
    keyed = mark(keyed, row_key(F.col("__id"), F.col("__hash")), "__maybe")
    joined = keyed.where("__maybe").join(linked, ["__id", "__hash"], "left")
    # rows without a class keep a number of their own, repeated rows of a representative have none
    own = F.when(F.col("__keeps").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    kept = joined.where("__keeps IS NULL OR __keeps").withColumn("__own", own)
    kept = kept.dropDuplicates(["__id", "__hash", "__own"])
    return keyed.where("NOT __maybe").select(*docs.columns).unionByName(kept.select(*docs.columns))
