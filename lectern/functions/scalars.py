"""Scalar rules: levels, tags, money, progress, labels, byte strings. Each is a Spark column expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits, prices and names that results depend on.
MAX_PAGES, LARGE_PAGES, MAX_MB = 500, 50, 50
FREE_PAGES, PAGE_PRICE, MODEL_PRICE = 3, 0.05, 0.025
UPLOAD_TTL, OUTPUT_TTL = 3600, 86400
SIMILAR_PAGE, SIMILAR_MEAN, PIXEL_STEP = 0.85, 0.70, 30
DEFAULT_WIDTH, DEFAULT_HEIGHT, MARGINS, SIZE_STEP = 8.5, 11.0, 1.5, 0.1
MATCH_SCORE = 0.2
TAGS = {"paragraph": "P", "table": "Table", "list": "L", "caption": "Caption", "image_alt": "Figure"}
GROUPING = {"Table": "Caption", "L": "P"}
BACKENDS = {"ollama": "Local AI", "claude": "Hosted AI", "mock": "Text only"}
#: Endings of output files.
DOCX_END, PDF_END, DOWNLOAD_END = "_accessible.docx", "_ada.pdf", "_ada_compliant.pdf"


def lookup(names: dict[str, str], key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def level(x: Column, default: int = 1) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(x, F.lit(default))))


def tag(kind: Column, lvl: Column) -> Column:
    return F.when(kind == "heading", F.concat(F.lit("H"), level(lvl).cast("string"))).otherwise(lookup(TAGS, kind, F.lit("P")))


def writable_tag(x: Column) -> Column:
    """Grouping tags are written as their leaf tags."""
    return lookup(GROUPING, x, x)


def billable(pages: Column) -> Column:
    return F.greatest(F.lit(0), pages - FREE_PAGES)


def amount(pages: Column) -> Column:
    return F.round(billable(pages) * F.lit(PAGE_PRICE), 2)


def cents_truncated(pages: Column) -> Column:
    """As charged: binary dollars times 100, fraction cut off; null where nothing is due."""
    return F.when(billable(pages) > 0, (amount(pages) * 100).cast("int"))


def progress(page: Column, pages: Column) -> Column:
    return ((page - 1) / pages * 88).cast("int")


def coverage_grade(pct: Column) -> Column:
    return F.when(pct >= 90, "ok").when(pct >= 75, "warning").otherwise("error")


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h, "LANDSCAPE").otherwise("PORTRAIT")


def file_title(path: Column) -> Column:
    """Title of a file's stem, underscores as spaces, words in title case after any character that isn't a letter."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return title(F.regexp_replace(stem, "_", " "))


def stem_title(stem: str) -> str:
    """As file_title, of one file's stem."""
    return stem.rsplit("/", 1)[-1].replace("_", " ").title()


@F.pandas_udf(StringType())
def title(x: pd.Series) -> pd.Series:
    """Title case that begins anew after any character that isn't a letter; the built-in does so after spaces alone."""
    return x.str.title()


def decoded(b: bytes) -> str:
    """A PDF string: UTF-16 by its byte-order mark, else Windows-1252; undecodable bytes are replaced."""
    for mark, name in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if b.startswith(mark):
            return b[2:].decode(name, "replace")
    return b.decode("cp1252", "replace")


@F.pandas_udf(StringType())
def decode_bytes(x: pd.Series) -> pd.Series:
    return x.map(lambda b: None if b is None else decoded(bytes(b)))
