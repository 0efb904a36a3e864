"""Names: table headers (on the driver) and name columns (on the executors)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of one header record, in order.
Naming = Callable[[Sequence[str | None]], list[str]]

_OUTSIDE_NAME = re.compile(r"[^0-9A-Za-z$]+")


def reader_names(header: Sequence[str | None]) -> list[str]:
    """Names a header record gets on reading.

    A blank cell is named by its 0-based position, a repeated name takes the
    first free ``.1``, ``.2``, ... and never takes a name the header holds.
    """
    wanted = [
        str(cell) if cell not in (None, "") else f"Unnamed: {position}"
        for position, cell in enumerate(header)
    ]
    taken, names = set(wanted), []
    used: set[str] = set()
    for name in wanted:
        if name in used:
            suffix = 1
            while f"{name}.{suffix}" in taken:
                suffix += 1
            name = f"{name}.{suffix}"
            taken.add(name)
        used.add(name)
        names.append(name)
    return names


def normalize_header(name: object) -> str:
    """Upper-case ASCII letters, digits and ``$``, everything else one ``_``."""
    decomposed = unicodedata.normalize("NFKD", str(name))
    ascii_only = "".join(char for char in decomposed if char.isascii())
    return _OUTSIDE_NAME.sub("_", ascii_only).strip("_").upper()


def column_names(headers: Iterable[object]) -> list[str]:
    """Normalised names, made unique with ``_2``, ``_3``, ... per base name.

    A header without any usable character is named ``COL_<position>``; a
    suffixed name that is already taken moves on to the next number.
    """
    seen: dict[str, int] = {}
    taken: set[str] = set()
    names = []
    for position, header in enumerate(headers):
        base = normalize_header(header) or f"COL_{position}"
        count = seen.get(base, 0) + 1
        name = base if count == 1 else f"{base}_{count}"
        while name in taken:
            count += 1
            name = f"{base}_{count}"
        seen[base] = count
        taken.add(name)
        names.append(name)
    return names


def table_names(header: Sequence[str | None]) -> list[str]:
    """Column names of a table for a header record as it was read."""
    return column_names(reader_names(header))


@F.arrow_udf(T.StringType())
def _nfkd(names: pa.Array) -> pa.Array:
    return pc.utf8_normalize(names, form="NFKD")


def normalize_name(name: Column) -> Column:
    """Lower-case ASCII letters and digits, every other run one ``_``.

    Spark has no compatibility decomposition, so names with non-ASCII
    characters (and only those) travel to Arrow; all else stays in the JVM.
    """
    foreign = F.when(name.rlike(r"[^\x00-\x7F]"), name)
    ascii_only = F.regexp_replace(F.coalesce(_nfkd(foreign), name), r"[^\x00-\x7F]+", "")
    return F.btrim(F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9]+", "_"), F.lit("_"))


def landing_path(url: Column, file_name: Column, base: str) -> Column:
    """``base/<normalised second-last URL segment>/<file name>``."""
    folder = normalize_name(F.try_element_at(F.split(url, "/"), F.lit(-2)))
    return F.concat_ws("/", F.lit(base.rstrip("/")), folder, file_name)


def file_format(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def uploaded_file_name(file_name: Column) -> Column:
    """Text before the first dot, lower-case."""
    return F.lower(F.substring_index(file_name, ".", 1))


def landed_file_name(path: Column) -> Column:
    """Second-last dot part of the whole path (so with its folders), lower-case."""
    return F.lower(F.try_element_at(F.split(path, r"\."), F.lit(-2)))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def qualified_name(*parts: str) -> str:
    """Back-quoted ``catalog.schema.table``."""
    return ".".join(quoted(part) for part in parts)
