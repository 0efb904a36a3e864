"""CSV files as text columns, split-parallel and exact.

A first pass over the plain lines finds, per file, its header line and
whether any quoted field runs past a line end. Files where none does are read
by Spark's CSV reader line by line, so that a large file is split over many
tasks. In the others the physical lines are first joined into records: also
in parallel, as each line only says how it changes the "inside quotes" state,
and a task that knows the state at the start of its split needs no other.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.functions.names import Naming, reader_names
from lakeload.functions.text import missing_to_null
from lakeload.sources.listing import Paths, as_list, literal_path, suffix_filter
from lakeload.session import remove_folders, shared_folder
from lakeload.sources.raw import InputError, RawTable

# One complete field: quoted (with anything up to the delimiter after the
# closing quote), or not starting with a quote, or empty.
_QUOTED = r'"(?:[^"]++|"")*+"[^,]*+'
_FIELD = rf'(?:{_QUOTED}|[^",][^,]*+|)'
_OPEN_FIELD = r'"(?:[^"]++|"")*+\z'
# The line ends inside a quoted field, having started outside / inside one.
OPEN_FROM_OUTSIDE = rf"^(?:{_FIELD},)*+{_OPEN_FIELD}"
OPEN_FROM_INSIDE = rf'^(?:[^"]++|"")*+(?:\z|"[^,]*+,(?:{_FIELD},)*+{_OPEN_FIELD})'

# The same for Python, where the end of the text is written in another way.
_OPEN_OUTSIDE = re.compile(OPEN_FROM_OUTSIDE.replace(r"\z", r"\Z"))
_OPEN_INSIDE = re.compile(OPEN_FROM_INSIDE.replace(r"\z", r"\Z"))

BLANK_LINE = r"^[ \t]*\r?\z"

_BLANK = re.compile(BLANK_LINE.replace(r"\z", r"\Z"))

# Columns of a file, and characters of one header field, that the parsers take.
MAX_COLUMNS = 1_000_000
MAX_FIELD = 2**31 - 1
# A header over more lines than this is refused as an open quote.
HEADER_LINES = 16**3


# Ways of reading, a header and a reader each, that get a branch of the plan of their own.
BRANCHES = 8
# Files, and cells of a table of places, that are sent to all tasks; beyond them Spark joins as it sees fit.
SENT_FILES = 100_000
SENT_PLACES = 4_000_000


@dataclass(frozen=True)
class _Group:
    """Files with the same header and the same way of reading."""

    header: list[str]
    files: list[str]
    joined: bool

    @property
    def paths(self) -> list[str]:
        return [literal_path(file) for file in self.files]


def _reader(spark: SparkSession, by_suffix: bool) -> DataFrameReader:
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", suffix_filter("csv")) if by_suffix else reader


def _lines(
    spark: SparkSession, paths: list[str], by_suffix: bool = False, line_end: str | None = None
) -> DataFrame:
    """Physical lines, as their bytes are, with their file, split and order."""
    return _reader(spark, by_suffix).text(paths, lineSep=line_end).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )


def _is_open(lines: list[str]) -> bool:
    """The first record does not end within these lines."""
    try:
        next(csv.reader((line + "\n" for line in lines), strict=True))
    except csv.Error as error:
        return "unexpected end of data" in str(error)
    return False


def _decoded(value: Column, encoding: str) -> Column:
    """Text of a line that was read as bytes; the line structure is ASCII in every known encoding."""
    return value if _is_utf8(encoding) else F.decode(value.cast("binary"), encoding)


def _is_utf8(encoding: str) -> bool:
    return encoding.upper().replace("-", "") == "UTF8"


def _header_record(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """The first record of one file; reads only as many lines as it spans."""
    csv.field_size_limit(MAX_FIELD)
    lines = spark.read.text(path).where(~F.col("value").rlike(BLANK_LINE))
    lines = lines.select(_decoded(F.col("value"), encoding).alias("value"))
    wanted = 1
    head = [row.value for row in lines.head(wanted)]
    while len(head) == wanted < HEADER_LINES and _is_open(head):
        wanted *= 16
        head = [row.value for row in lines.head(wanted)]
    if _is_open(head):
        raise InputError(f"a quoted field in the header of {path} does not end within {wanted} lines")
    return _parsed_header(head, path)


def _parsed_header(lines: list[str], path: str) -> list[str]:
    csv.field_size_limit(MAX_FIELD)
    try:
        return next(csv.reader(line + "\n" for line in lines))
    except csv.Error as error:
        raise InputError(f"the header of {path} cannot be read: {error}") from None


_PARTS = "file string, joined boolean, invalid boolean, header string"


def _parts(lines: DataFrame, encoding: str) -> DataFrame:
    """What a task sees of each file: open quotes, bytes that are no text, the header record.

    A header is null where another task has the start of the file, and where the
    record does not end within the task or ``HEADER_LINES`` lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, head, state = "", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files = batch.column("file")
            ends = pc.run_end_encode(files).run_ends.to_numpy()
            starts = np.r_[0, ends[:-1]]
            opens, wrong = (np.asarray(batch.column(name).to_numpy(zero_copy_only=False)) for name in ("open", "invalid"))
            names, headers = [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                file, done = files[a].as_py(), None
                if file != here:
                    here, head, state = file, [] if batch.column("block")[a].as_py() == 0 else None, 0
                while head is not None and a < b:
                    head.append(batch.column("text")[a].as_py().decode(encoding, "replace"))
                    state = int(opens[a]) if len(head) == 1 else _changes(head[-1])[state]
                    a += 1
                    if not state:
                        done, head = "\n".join(head), None
                    elif len(head) >= HEADER_LINES:
                        head = None
                names.append(file)
                headers.append(done)
            found = [np.logical_or.reduceat(flags, starts) for flags in (opens, wrong)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), *map(pa.array, found), pa.array(headers, pa.string())],
                ["file", "joined", "invalid", "header"],
            )

    return lines.mapInArrow(run, _PARTS)


def _groups(
    spark: SparkSession, paths: list[str], by_suffix: bool, encoding: str
) -> list[_Group]:
    """Group the files by header and by reading, in one pass over the lines.

    One row per file and task is shuffled. Headers come with that pass, however
    many there are; only one that runs over the end of a split is read again.
    The driver learns file names and headers, as any file scan's does, and later
    passes read exactly these files. Files with bytes that are not text in their
    encoding are refused.
    """
    lines = _lines(spark, paths, by_suffix).where(~F.col("value").rlike(BLANK_LINE))
    invalid = ~F.is_valid_utf8("value") if _is_utf8(encoding) else F.lit(False)
    is_open = F.col("value").contains('"') & F.col("value").rlike(OPEN_FROM_OUTSIDE)
    lines = lines.select(
        "file",
        "block",
        is_open.alias("open"),
        invalid.alias("invalid"),
        # headers are looked for at the start of files only
        F.when(F.col("block") == 0, F.col("value").cast("binary")).alias("text"),
    )
    per_file = _parts(lines, encoding).groupBy("file").agg(
        F.bool_or("joined").alias("joined"), F.bool_or("invalid").alias("invalid"), F.max("header").alias("header")
    )
    # A header that no task has seen whole is known only by its file.
    own_header = F.when(F.col("header").isNull(), F.col("file"))
    grouped = (
        per_file.groupBy("header", "joined", own_header)
        .agg(
            F.sort_array(F.collect_list("file")).alias("files"),
            F.min(F.when(F.col("invalid"), F.col("file"))).alias("invalid"),
        )
        .collect()
    )
    if not grouped:
        raise InputError(f"no CSV lines in {', '.join(paths)}")
    wrong = min((row.invalid for row in grouped if row.invalid), default=None)
    if wrong:
        raise InputError(f"{wrong} is not {encoding}; give the encoding of the file")
    found: dict[tuple, list[str]] = {}
    for row in grouped:
        path = literal_path(row.files[0])
        if row.header is None:
            header = _header_record(spark, path, encoding)
        else:
            header = _parsed_header(row.header.split("\n"), path)
        found.setdefault((tuple(header), row.joined), []).extend(row.files)
    groups = [_Group(list(header), sorted(files), joined) for (header, joined), files in found.items()]
    return sorted(groups, key=lambda group: group.files[0])


def _schema(width: int) -> T.StructType:
    """Text columns for the header, and the whole record where its number of fields is another."""
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(width)]
    return T.StructType([*fields, T.StructField(RECORD, T.StringType())])


# The record of a row whose number of fields differs from the header's.
RECORD = "odd_record"


def _options(width: int) -> dict[str, str]:
    return {
        "escape": '"',
        "mode": "PERMISSIVE",
        "maxColumns": str(max(MAX_COLUMNS, width)),
        "columnNameOfCorruptRecord": RECORD,
        # fields beyond the header are only seen where every field is read
        "columnPruning": "false",
    }


def too_long(record: Column, width: int | Column) -> Column:
    """The record, if it has more than ``width`` fields, whatever these hold; else null.

    A record with ``width`` complete fields that each end in a comma has one more.
    """
    commas = F.length(record) - F.length(F.replace(record, F.lit(","), F.lit("")))
    if isinstance(width, int):
        pattern = F.lit(rf"(?s)^(?:{_FIELD},){{{width}}}")
    else:
        pattern = F.concat(F.lit(rf"(?s)^(?:{_FIELD},){{"), width.cast("string"), F.lit("}"))
    return F.when((commas >= width) & F.rlike(record, pattern), record)


def _read_split(spark: SparkSession, paths: list[str], width: int, encoding: str) -> DataFrame:
    """Fields ``f0`` to ``f<width - 1>``, the record where it has another number of fields, and the file."""
    reader = spark.read.schema(_schema(width)).option("encoding", encoding)
    frame = reader.options(header="true", **_options(width)).csv(paths)
    return frame.withColumn("file", F.col("_metadata.file_path"))


def _changes(line: str) -> tuple[int, int]:
    """The state "inside quotes" after a line, from outside and from inside."""
    if '"' not in line:
        return 0, 1
    return int(_OPEN_OUTSIDE.match(line) is not None), int(_OPEN_INSIDE.match(line) is not None)


def _rows(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[tuple[str, tuple[str, int]]]:
    """Lines of a task in the order of the scan, with their split (file and first byte)."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        for line, file, block in zip(batch.column("line").to_pylist(), files, blocks, strict=True):
            yield line.decode(encoding), (file, block)


_MAPS = "file string, block bigint, outside int, inside int, closes boolean"


def _split_maps(lines: DataFrame, encoding: str) -> DataFrame:
    """What each split does to the state "inside quotes": its end from outside and from inside.

    A line maps the state at its start to the state at its end; a task composes
    these maps over each of its splits. ``closes`` tells that a field open at the
    start of the split ends within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[int, int, bool]] = {}
        for line, split in _rows(batches, encoding):
            outside, inside, closes = found.get(split, (0, 1, False))
            change = _changes(line)
            found[split] = change[outside], change[inside], closes or not change[inside]
        columns = [(*split, *ends) for split, ends in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in columns], schema)

    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("outside", pa.int32()), ("inside", pa.int32()),
         ("closes", pa.bool_())]
    )
    return lines.mapInArrow(run, _MAPS)


# Splits of a file that one task puts in order, about; so many again make the next level.
CHUNK_SPLITS = 1000


def _after(state: Column) -> Column:
    """The state after a row's map."""
    return F.when(state == 0, F.col("outside")).otherwise(F.col("inside"))


def _with_prefix(maps: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds the state before each map: ``fixed``, or, where that is null, the state at the start of the group plus ``flips``.

    A map of two states either gives one state, or keeps the state, or turns it. So
    what matters is the last map that gives one, and the number of turns since.
    """
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("outside") > F.col("inside")).cast("int")
    gives = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "turned"))
    counted = maps.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    last = counted.withColumn("last", F.last(gives, ignorenulls=True).over(before))
    fixed = (F.col("last.outside") + F.col("turned") - F.col("last.turned")) % 2
    return last.withColumns({"fixed": fixed.cast("int"), "flips": (F.col("turned") % 2).cast("int")}).drop("last", "turned")


def _state(start: Column) -> Column:
    return F.coalesce("fixed", (start + F.col("flips")) % 2)


def _states(maps: DataFrame) -> DataFrame:
    """(file, block, state, end, begin): the state at the start of each split and at its end.

    ``begin`` is the split in which the record begins that is open at the start.
    A parallel prefix in two levels: chunks of neighbouring splits are composed by
    themselves, then the chunks of a file, and joined back. So no task orders all
    splits of a large file.
    """
    sizes = maps.groupBy("file").agg(F.max("block").alias("bytes"), F.count("*").alias("n"))
    sizes = sizes.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    width = max(1, CHUNK_SPLITS * (sizes.bytes or 0) // max(1, sizes.n or 0))
    rows = _with_prefix(maps.withColumn("chunk", F.floor(F.col("block") / width)), ["file", "chunk"], "block")
    ends = F.struct(_after(_state(F.lit(0))).alias("outside"), _after(_state(F.lit(1))).alias("inside"))
    chunks = rows.groupBy("file", "chunk").agg(F.max_by(ends, "block").alias("ends")).select("file", "chunk", "ends.*")
    chunks = _with_prefix(chunks, ["file"], "chunk").select("file", "chunk", _state(F.lit(0)).alias("start"))
    known = rows.join(chunks, ["file", "chunk"]).withColumn("state", _state(F.col("start")))
    known = known.withColumn("end", _after(F.col("state")))
    # a record that is open at the end begins here, unless it was open all along
    begins = F.when((F.col("end") == 1) & ((F.col("state") == 0) | F.col("closes")), F.col("block"))
    known = known.withColumn("begins", begins)
    past = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = known.groupBy("file", "chunk").agg(F.max("begins").alias("begins"))
    earlier = earlier.select("file", "chunk", F.max("begins").over(past).alias("earlier"))
    near = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("near", F.max("begins").over(near)).join(earlier, ["file", "chunk"])
    return known.select("file", "block", "state", "end", F.coalesce("near", "earlier").alias("begin"))


def _open_starts(maps: DataFrame) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], str | None]:
    """Splits that start inside quotes, with where their record begins, by file; and a file that ends inside.

    This is what the driver learns and sends: two numbers for such a split, so
    that a hundred terabytes in splits of 128 MB take 13 MB if all do.
    """
    known = _states(maps)
    pair = F.when(F.col("state") == 1, F.struct("block", "begin"))
    files = known.groupBy("file").agg(
        F.sort_array(F.collect_list(pair)).alias("open"), F.max_by("end", "block").alias("end")
    )
    starts, unfinished = {}, []
    for row in files.where("end = 1 OR size(open) > 0").toLocalIterator():
        if row.end:
            unfinished.append(row.file)
        starts[row.file] = tuple(np.array(row.open, np.int64).reshape(-1, 2).T)
    return starts, min(unfinished, default=None)


# What a task makes of its lines: whole records, and pieces of those that cross the edge of a split.
_WHOLE, _END, _START, _MIDDLE, _HEADER_START = range(5)
_PIECES = "file string, block bigint, begin bigint, kind int, record string"
_RECORDS = "file string, record string"


def _pieces(lines: DataFrame, starts: dict[str, tuple[np.ndarray, np.ndarray]], encoding: str) -> DataFrame:
    """Records and pieces of records, in the task that reads their lines.

    A piece goes with the split in which its record begins. The header of each
    file, its first record, is left out, and so are blank lines between records. A
    carriage return before the line end stays inside quotes and goes at the end of
    a record.
    """
    shared = lines.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        done: list[tuple[str, int, int, int, str]] = []
        here, begin, state, head, header = ("", -1), 0, 0, False, False
        open_lines: list[str] = []

        def leave() -> None:
            if open_lines:
                kind = _MIDDLE if head else _HEADER_START if header else _START
                done.append((*here, begin if head else here[1], kind, "\n".join(open_lines)))
                open_lines.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(schema)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
            )

        for line, split in _rows(batches, encoding):
            if split != here:
                leave()
                here, header = split, split[1] == 0
                blocks, begins = starts.get(split[0], _NO_STARTS)
                place = int(np.searchsorted(blocks, split[1]))
                state = int(place < len(blocks) and blocks[place] == split[1])
                begin = int(begins[place]) if state else split[1]
                head = bool(state)
            after = _changes(line)[state]
            if not state and not after and _BLANK.match(line):
                continue
            open_lines.append(line if after else line.removesuffix("\r"))
            if not after:
                if head or not header:
                    done.append((*here, begin, _END if head else _WHOLE, "\n".join(open_lines)))
                header = header and head
                head = False
                open_lines.clear()
            state = after
            if len(done) >= RECORDS_PER_BATCH:
                yield batch_of()
        leave()
        yield batch_of()

    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("begin", pa.int64()), ("kind", pa.int32()),
         ("record", pa.string())]
    )
    return lines.mapInArrow(run, _PIECES)


_NO_STARTS = np.empty(0, np.int64), np.empty(0, np.int64)
RECORDS_PER_BATCH = 10_000


def _crossing(pieces: DataFrame) -> DataFrame:
    """Records put together from their pieces; a task holds the pieces of single records."""
    return (
        pieces.groupBy("file", "begin")
        .agg(
            F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"),
            F.bool_or(F.col("kind") == _HEADER_START).alias("is_header"),
        )
        .where(~F.col("is_header"))
        .select("file", F.array_join("parts.record", "\n").alias("record"))
    )


def _read_joined(spark: SparkSession, paths: list[str], width: int, folder: str, encoding: str) -> DataFrame:
    """As ``_read_split``, for files with line ends in quotes.

    Every task puts together the records of its splits; only pieces that cross
    the edge of a split are shuffled, and kept in the shared folder. A quote
    left open would make one record of the rest of its file, so it is refused.
    """
    lines = _lines(spark, paths, line_end="\n")
    lines = lines.select(F.col("value").cast("binary").alias("line"), "file", "block")
    _split_maps(lines, encoding).write.parquet(f"{folder}/splits")
    starts, open_file = _open_starts(spark.read.schema(_MAPS).parquet(f"{folder}/splits"))
    if open_file is not None:
        raise InputError(f"a quoted field does not end before the end of {open_file}")
    pieces = _pieces(lines, starts, encoding)
    every = pieces.where(F.col("kind") == _WHOLE).select("file", "record")
    if starts:
        _crossing(pieces.where(F.col("kind") != _WHOLE)).write.parquet(f"{folder}/records")
        every = every.unionAll(spark.read.schema(_RECORDS).parquet(f"{folder}/records"))
    # with multiLine the parser leaves line ends in quotes as they are
    options = {**_options(width), "multiLine": "true"}
    fields = F.from_csv("record", _schema(width).simpleString(), options)
    parsed = every.select("file", "record", fields.alias("fields")).select("file", "record", "fields.*")
    return parsed.withColumn(RECORD, F.col("record")).drop("record")


def _cells(frame: DataFrame, header: list[str], names: list[str], joined: bool) -> DataFrame:
    """Cells by table column, for files of one header, which names its places in the plan."""
    place = {name: i for i, name in enumerate(header)}
    null = F.lit(None).cast("string")
    cells = [
        (missing_to_null(f"f{place[name]}") if name in place else null).alias(f"c{k}") for k, name in enumerate(names)
    ]
    return frame.select(*cells, _overflow(F.lit(len(header)), len(header), joined))


def _overflow(width: Column, literal: int | None, joined: bool) -> Column:
    record = too_long(F.col(RECORD), width if literal is None else literal)
    # the splitting reader does not give the record alone, so a cell goes with it
    return (record if joined else F.concat(record, F.coalesce("f0", F.lit("")))).alias("overflow")


def _cells_by_file(
    frame: DataFrame, groups: list[_Group], headers: list[list[str]], names: list[str], joined: bool
) -> DataFrame:
    """Cells by table column, for files of many headers: one plan, whatever their number.

    A header's places say in which field of its files each table column is. Files
    find their header, and so its places and width, by two joins.
    """
    spark = frame.sparkSession
    width = max(len(header) for header in headers)
    positions = [{name: i for i, name in enumerate(header)} for header in headers]
    places = [(h, len(headers[h]), [p.get(name, -1) for name in names]) for h, p in enumerate(positions)]
    of_file = [(file, h) for h, group in enumerate(groups) for file in group.files]
    known = spark.createDataFrame(places, "header int, width int, places array<int>")
    files = spark.createDataFrame(of_file, "file string, header int")
    known = F.broadcast(known) if len(places) * len(names) <= SENT_PLACES else known
    files = F.broadcast(files) if len(of_file) <= SENT_FILES else files
    fields = F.array(*[F.col(f"f{i}") for i in range(width)]).alias("fields")
    found = frame.join(files, "file").join(known, "header")
    found = found.select(fields, "places", _overflow(F.col("width"), None, joined))
    # no field has place -1, and a field that a short row lacks is null
    moved = found.select(*[F.get("fields", F.get("places", F.lit(k))).alias(f"c{k}") for k in range(len(names))], "overflow")
    return moved.select(*[missing_to_null(f"c{k}").alias(f"c{k}") for k in range(len(names))], "overflow")


def scan_csv_text(
    spark: SparkSession,
    paths: Paths,
    by_suffix: bool = False,
    naming: Naming = reader_names,
    encoding: str = "UTF-8",
) -> RawTable:
    """All CSV files below ``paths`` as one table of text columns.

    Columns are matched by the names that ``naming`` gives to the header of
    each file, not by position; a column that a file lacks is null there. Short
    rows are filled with nulls; rows with too many fields make the profile
    fail, whatever these fields hold. Missing tokens are null. ``encoding`` is
    UTF-8 or another one whose first 128 characters are ASCII.
    """
    groups = _groups(spark, as_list(paths), by_suffix, encoding)
    headers = [naming(group.header) for group in groups]
    names = list(dict.fromkeys(name for header in headers for name in header))
    frames: list[DataFrame] = []
    stored: list[str] = []

    def read(files: list[str], width: int, joined: bool) -> DataFrame:
        if not joined:
            return _read_split(spark, files, width, encoding)
        stored.append(shared_folder(spark, "csv-records"))
        return _read_joined(spark, files, width, stored[-1], encoding)

    try:
        for joined in (False, True):
            chosen = [k for k, group in enumerate(groups) if group.joined == joined]
            if len(chosen) <= (1 if joined else BRANCHES):
                for k in chosen:
                    frame = read(groups[k].paths, len(headers[k]), joined)
                    frames.append(_cells(frame, headers[k], names, joined))
                continue
            some, of_some = [groups[k] for k in chosen], [headers[k] for k in chosen]
            frame = read([path for group in some for path in group.paths], max(map(len, of_some)), joined)
            frames.append(_cells_by_file(frame, some, of_some, names, joined))
    except BaseException:
        remove_folders(spark, stored)
        raise
    return RawTable(
        frame=reduce(DataFrame.unionAll, frames),
        names=names,
        cells=[F.col(f"c{k}") for k in range(len(names))],
        is_text=True,
        overflow=F.col("overflow"),
        probe=True,
        stored=stored,
    )
