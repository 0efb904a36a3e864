"""Cell text: blanks, missing tokens, null markers and base64 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that the readers take as missing, compared untrimmed.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Cells that cleaning turns into null, compared after trimming.
NULL_MARKERS = ("-", "None")

# Every code point that str.strip() removes; F.trim alone takes off U+0020 only.
BLANKS = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())


_TOKENS_SQL = ", ".join(f"'{token}'" for token in MISSING_TOKENS)


def missing_to_null(column: str) -> Column:
    """A text column without its missing tokens; one expression to build, as inputs can be wide."""
    return F.expr(f"CASE WHEN `{column}` NOT IN ({_TOKENS_SQL}) THEN `{column}` END")


def trim_text(cell: Column) -> Column:
    return F.btrim(cell, F.lit(BLANKS))


def markers_to_null(cell: Column) -> Column:
    return F.when(~cell.isin(*NULL_MARKERS), cell)


def clean_text(cell: Column) -> Column:
    """Trim a text cell, then turn a whole-cell marker into null."""
    return markers_to_null(trim_text(cell))


def decode_text(encoded: Column) -> Column:
    """Base64 to UTF-8 text, trimmed and without double quotes."""
    text = F.decode(F.unbase64(encoded), "UTF-8")
    return F.replace(trim_text(text), F.lit('"'), F.lit(""))


def share_token(url: Column) -> Column:
    """``u!`` followed by the URL-safe, unpadded base64 of the link.

    Spark breaks base64 text into lines of 76 characters by default, so line
    ends are removed together with the padding.
    """
    return F.concat(
        F.lit("u!"), F.translate(F.base64(F.encode(url, "UTF-8")), "+/=\r\n", "-_")
    )
