"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, so that the largest cosine is the smallest
Euclidean distance. Each of ``TABLES`` tables hashes a vector to a bucket by
``floor((a.v + b) / w)`` for several Gaussian (2-stable) directions a. A query
visits its own bucket and perturbed ones, in the order of the estimated chance
that they hold a near vector; candidates of all tables are ranked by their exact
cosine in double precision.

- The number of directions grows with the logarithm of the number of vectors.
- The number of visited buckets is fitted on a bounded sample: the smallest one
  that finds the sample's own neighbours with the wanted recall. Neighbours in
  all vectors are nearer than those in a sample, so recall is at least that.
- Vectors of a length that has no more of them than the sample, or for which the
  bound of visits does not reach the recall, are all compared, block by block.
- Equal vectors form a class with its smallest ids, hashed and ranked once.
- A bucket of more than ``BLOCK`` classes is cut into blocks, and its visitors
  are sent to each block, so nothing is capped.
- A task keeps the best of each query over all the buckets it holds, so pairs
  are never shuffled.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without an id. Rows that repeat an id count once. Vectors of
different lengths never meet.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm.common import stored

TABLES = 8
#: Wanted recall on the sample, and the bound of the sample.
RECALL = 0.96
SAMPLE = 3000
WIDTH = 2.5
#: Visits of a query to a table, at most; where these do not reach the recall, all vectors are compared.
MAX_PROBES = 4096
#: Queries of the sample that the visits are fitted on.
FIT_QUERIES = 60
#: About so many entries share a bucket; below that, visits cost more than they save.
ENTRIES = 512
BLOCK = 4096
#: Cosines of a product that differ by less may be equal; they are then computed exactly.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Hashes:
    """Directions and offsets of all tables for one vector length; without probes all vectors are compared."""

    directions: np.ndarray  # dimension x (tables * per table)
    offsets: np.ndarray
    per_table: int
    width: float
    probes: int

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Positions in units of the width: vectors x tables x directions."""
        found = (unit @ self.directions + self.offsets) / self.width
        return found.reshape(len(unit), -1, self.per_table)


def make_hashes(dimension: int, count: int, probes: int, tables: int = TABLES, width: float = WIDTH) -> Hashes:
    per_table = max(2, round(math.log2(max(count, 2) / ENTRIES)))
    random = np.random.default_rng(dimension)
    directions = random.normal(size=(dimension, tables * per_table))
    return Hashes(directions, random.uniform(0, width, tables * per_table), per_table, width, probes)


def _keys(cells: np.ndarray, table: int) -> np.ndarray:
    """64-bit key of each row of cell numbers."""
    out = np.full(len(cells), (table + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    with np.errstate(over="ignore"):
        for column in cells.T:
            out = (out ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def probe_cells(place: np.ndarray, probes: int) -> np.ndarray:
    """Cells to visit for one query and table, the likeliest first.

    The cost of moving one cell along a direction is the squared distance to
    that side of the cell; sets of moves are taken in the order of their sum.
    """
    home = np.floor(place)
    into = place - home
    m = len(place)
    costs = np.concatenate([into**2, (1 - into) ** 2])
    order = np.argsort(costs, kind="stable")
    costs = costs[order]
    axis, step = order % m, np.where(order < m, -1, 1)
    cells = [home]
    heap = [(costs[0], (0,))]
    while heap and len(cells) < probes:
        cost, chosen = heapq.heappop(heap)
        axes = axis[list(chosen)]
        if len(set(axes.tolist())) == len(chosen):
            cell = home.copy()
            cell[axes] += step[list(chosen)]
            cells.append(cell)
        last = chosen[-1]
        if last + 1 < len(costs):
            heapq.heappush(heap, (cost - costs[last] + costs[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + costs[last + 1], (*chosen, last + 1)))
    return np.array(cells)


def first_finds(unit: np.ndarray, hashes: Hashes, query: int, k: int) -> np.ndarray:
    """The probe that finds each of the ``k`` nearest neighbours of a row of ``unit`` among the others."""
    top = np.argsort(-(unit @ unit[query]), kind="stable")
    top = top[top != query][:k]
    places = hashes.places(unit[np.r_[query, top]])
    first = np.full(len(top), np.inf)
    for t in range(places.shape[1]):
        keys = _keys(np.floor(places[1:, t]), t)
        ranks = {key: r for r, key in reversed(list(enumerate(_keys(probe_cells(places[0, t], MAX_PROBES), t))))}
        first = np.minimum(first, [ranks.get(key, np.inf) for key in keys])
    return first


def fit_probes(spark: SparkSession, sample: np.ndarray, count: int, k: int = 5, recall: float = RECALL) -> Hashes:
    """Hashes with the fewest probes that reach ``recall`` within the sample; none if ``MAX_PROBES`` do not.

    The queries are looked at by tasks, which get the bounded sample.
    """
    unit = sample / np.sqrt((sample**2).sum(axis=1))[:, None]
    hashes = make_hashes(sample.shape[1], count, 1)
    chosen = range(0, len(unit), max(1, len(unit) // FIT_QUERIES))[:FIT_QUERIES]
    shared = spark.sparkContext.broadcast((unit, hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, hashes = shared.value
        for batch in batches:
            found = [first_finds(unit, hashes, query, k) for query in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0), *found]))], ["first"])

    queries = spark.createDataFrame([(query,) for query in chosen], "query int").repartition(len(chosen), "query")
    first = np.sort(queries.mapInArrow(run, "first double").toArrow()["first"].to_numpy())
    needed = first[math.ceil(recall * first.size) - 1] + 1
    return make_hashes(sample.shape[1], count, int(needed) if needed <= MAX_PROBES else 0)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision, with exactly rounded sums, whatever the order of the work."""
    dot = math.fsum((a * b).tolist())
    return dot / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist())))


def _classes(vectors: DataFrame, keep: int, id_column: str, vector_column: str) -> DataFrame:
    """(digest, vector, ids): every distinct usable vector with its ``keep`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, list[int]] = {}
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or not vector or any(x is None for x in vector):
                    continue
                array = np.array(vector, np.float64)
                if not np.isfinite(array).all() or not array.any():
                    continue
                known.setdefault(array.tobytes(), []).append(vec_id)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in known], pa.binary()),
                    pa.array(list(known), pa.binary()),
                    pa.array([sorted(set(ids))[:keep] for ids in known.values()], pa.list_(pa.int64())),
                    pa.array([hash(tuple(ids[:1])) % 64 for ids in known.values()], pa.int32()),
                ],
                ["digest", "vector", "ids", "slice"],
            )

    schema = "digest binary, vector binary, ids array<bigint>, slice int"
    found = vectors.select(F.col(id_column).cast("bigint"), vector_column).mapInArrow(run, schema)
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    # batches hold few rows of a class already; merge them in slices first, so no list grows with the class
    found = found.groupBy("digest", "slice").agg(F.first("vector").alias("vector"), least)
    return found.groupBy("digest").agg(F.first("vector").alias("vector"), least)


def search(
    vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose id is divisible by ``every``.

    Candidates are all rows but the query's own; equal scores go to the smaller id.
    """
    classes = stored(_classes(vectors, k + 1, id_column, vector_column), "classes")
    queries = vectors.where(F.col(id_column) % every == 0)
    # every query row finds its class by the same digest
    own = _classes_of_rows(queries, id_column, vector_column)
    asked = stored(own.distinct(), "queries")
    count = classes.count()
    hashes = _fit(classes, count, k)
    shared = vectors.sparkSession.sparkContext.broadcast(hashes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _hashed(batch, shared.value, visit=False)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _hashed(batch, shared.value, visit=True)

    schema = "bucket bigint, digest binary, vector binary, least bigint"
    listed = ["digest", "vector", F.element_at("ids", 1).alias("least")]
    entries = classes.select(*listed).mapInArrow(index, schema)
    probes = asked.select("digest").distinct().join(classes, "digest").select(*listed)
    probes = probes.mapInArrow(visits, schema)
    large = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = large.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    entries = entries.join(large, "bucket", "left").select(
        "bucket",
        F.coalesce(F.pmod(F.xxhash64("digest"), F.col("blocks")), F.lit(0)).cast("int").alias("block"),
        F.lit(0).alias("visit"),
        "digest",
        "vector",
        "least",
    )
    probes = probes.join(large, "bucket", "left").select(
        "bucket",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))).alias("block"),
        F.lit(1).alias("visit"),
        "digest",
        "vector",
        "least",
    )
    met = entries.unionByName(probes).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "visit")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _ranked(batches, k)

    best = met.mapInArrow(rank, "query binary, digest binary, score double").distinct()
    # neighbours of a query class, with the ids of their classes; its own class is at hand
    found = best.join(classes.select("digest", "ids"), "digest").groupBy("query").agg(
        F.collect_list(F.struct("score", "ids")).alias("near")  # at most k+1 a visited task
    )
    rows = asked.join(classes, "digest").join(found.withColumnRenamed("query", "digest"), "digest", "left")
    pairs = F.flatten(
        F.transform(
            F.concat(
                F.array(F.struct(F.col("alike").alias("score"), F.col("ids").alias("ids"))),
                F.coalesce("near", F.array().cast("array<struct<score:double,ids:array<bigint>>>")),
            ),
            lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("far"), i.alias("vec_id"))),
        )
    )
    others = F.filter(pairs, lambda p: p["vec_id"] != F.col("query_id"))
    nearest = F.slice(F.array_sort(F.array_distinct(others)), 1, k)
    out = rows.select("query_id", F.posexplode(nearest).alias("rank", "hit"))
    return out.select(
        "query_id",
        (F.col("rank") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.far")).alias("score"),
    )


def _classes_of_rows(queries: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, alike = [], [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or not vector or any(x is None for x in vector):
                    continue
                array = np.array(vector, np.float64)
                if np.isfinite(array).all() and array.any():
                    ids.append(vec_id)
                    digests.append(hashlib.blake2b(array.tobytes(), digest_size=16).digest())
                    alike.append(cosine(array, array))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(alike, pa.float64())],
                ["query_id", "digest", "alike"],
            )

    narrow = queries.select(F.col(id_column).cast("bigint"), vector_column)
    return narrow.mapInArrow(run, "query_id bigint, digest binary, alike double")


def _fit(classes: DataFrame, count: int, k: int) -> dict[int, Hashes]:
    """Hashes by vector length, fitted on at most about SAMPLE vectors chosen by their digest."""
    share = min(1.0, SAMPLE / max(1, count))
    steps = 1 << 30
    chosen = classes.where(F.pmod(F.xxhash64("digest"), F.lit(steps)) < int(share * steps))
    by_length: dict[int, list[np.ndarray]] = {}
    for row in chosen.select("digest", "vector").orderBy("digest").collect():
        vector = np.frombuffer(row["vector"], np.float64)
        by_length.setdefault(len(vector), []).append(vector)
    sizes = classes.groupBy((F.length("vector") / 8).cast("int").alias("length")).agg(F.count("*").alias("n")).collect()
    out = {}
    for length, n in sorted(map(tuple, sizes)):
        sample = np.array(by_length.get(length, [])).reshape(-1, length)
        few = n <= SAMPLE or len(sample) <= max(k, FIT_QUERIES)
        out[length] = make_hashes(length, count, 0) if few else fit_probes(classes.sparkSession, sample, count, k)
    return out


def _hashed(batch: pa.RecordBatch, hashes: dict[int, Hashes], visit: bool) -> Iterator[pa.RecordBatch]:
    digests, vectors, least = (batch.column(c).to_pylist() for c in range(3))
    for length, h in hashes.items():
        chosen = [k for k, v in enumerate(vectors) if len(v) == 8 * length]
        step = max(1, 65_536 // max(1, h.probes)) if visit else 16_384
        for start in range(0, len(chosen), step):
            part = chosen[start : start + step]
            if not h.probes:
                yield _rows_of([np.full(len(part), length, np.int64)], part, digests, vectors, least)
                continue
            array = np.array([np.frombuffer(vectors[k], np.float64) for k in part])
            unit = array / np.abs(array).max(axis=1)[:, None]
            unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
            places = h.places(unit)
            buckets, owner = [], []
            for t in range(places.shape[1]):
                if visit:
                    for i, k in enumerate(part):
                        keys = np.unique(_keys(probe_cells(places[i, t], h.probes), t * 1000 + length))
                        buckets.append(keys)
                        owner += [k] * len(keys)
                else:
                    buckets.append(_keys(np.floor(places[:, t]), t * 1000 + length))
                    owner += part
            yield _rows_of(buckets, owner, digests, vectors, least)


def _rows_of(buckets: list[np.ndarray], owner: list[int], digests: list, vectors: list, least: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(buckets)),
            pa.array([digests[k] for k in owner], pa.binary()),
            pa.array([vectors[k] for k in owner], pa.binary()),
            pa.array([least[k] for k in owner], pa.int64()),
        ],
        ["bucket", "digest", "vector", "least"],
    )


def _trim(found: dict[bytes, float], keep: int, query: np.ndarray, known: dict[bytes, tuple[bytes, int]]) -> None:
    """Leave the ``keep`` nearest classes; of those that may be equally near the exactly nearest, then smallest ids."""
    if len(found) <= keep:
        return
    order = sorted(found, key=found.__getitem__, reverse=True)
    edge = found[order[keep - 1]]
    sure = sum(found[digest] > edge + ROUNDING for digest in order[:keep])
    tied = [digest for digest in order[sure:] if found[digest] >= edge - ROUNDING]
    if len(tied) > keep - sure:
        tied.sort(key=lambda d: (-cosine(query, np.frombuffer(known[d][0], np.float64)), known[d][1]))
    for digest in {*order[sure:]}.difference(tied[: keep - sure]):
        del found[digest]


def _ranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Best k classes of every query over the buckets of a task; rows come by bucket, entries before visits."""
    best: dict[bytes, dict[bytes, float]] = {}
    asked: dict[bytes, bytes] = {}
    known: dict[bytes, tuple[bytes, int]] = {}
    here: tuple[int, int] | None = None
    entries: list[tuple[bytes, bytes, int]] = []
    keep = k + 2
    unit: np.ndarray | None = None

    def flush() -> pa.RecordBatch:
        rows = []
        for query, found in best.items():
            a = np.frombuffer(asked[query], np.float64)
            _trim(found, keep, a, known)
            for digest in found:
                rows.append((query, digest, cosine(a, np.frombuffer(known[digest][0], np.float64))))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        best.clear()
        asked.clear()
        known.clear()
        kinds = (pa.binary(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["query", "digest", "score"]
        )

    def visit(queries: list[tuple[bytes, bytes]]) -> None:
        nonlocal unit
        if not entries or not queries:
            return
        if unit is None:
            unit = _units([v for _, v, _ in entries])
        near = _units([v for _, v in queries]) @ unit.T
        edges = np.partition(near, -min(keep, len(entries)), axis=1)[:, -min(keep, len(entries))]
        close = near >= edges[:, None] - ROUNDING
        for q, (query, vector) in enumerate(queries):
            asked[query], a = vector, np.frombuffer(vector, np.float64)
            these: dict[bytes, float] = {}
            for e in np.flatnonzero(close[q]).tolist():
                digest, entry, least = entries[e]
                if digest != query:
                    these[digest] = float(near[q, e])
                    known[digest] = entry, least
            _trim(these, keep, a, known)
            found = best.setdefault(query, {})
            found.update(these)
            if len(found) > 4 * keep:
                _trim(found, keep, a, known)

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        flags, digests, values, least = (batch.column(c).to_pylist() for c in (2, 3, 4, 5))
        pending: list[tuple[bytes, bytes]] = []
        for key, flag, digest, vector, first in zip(keys, flags, digests, values, least, strict=True):
            if key != here:
                visit(pending)
                pending = []
                here, entries, unit = key, [], None
            if flag:
                if entries:
                    pending.append((digest, vector))
            else:
                entries.append((digest, vector, first))
        visit(pending)
        if len(known) > 500_000:
            yield flush()
    yield flush()


def _units(vectors: list[bytes]) -> np.ndarray:
    array = np.array([np.frombuffer(v, np.float64) for v in vectors])
    array = array / np.abs(array).max(axis=1)[:, None]
    return array / np.sqrt((array**2).sum(axis=1))[:, None]
