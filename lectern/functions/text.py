"""Text functions as Spark columns, and the same in SQL text for the oracle queries.

White space and line boundaries are those of Unicode text, spelled with \\x{...} escapes that both regex engines read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, line boundaries, and the punctuation stripped from words.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BOUNDARY = r"\x{0D}\x{0A}|[\x{0A}-\x{0D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ENDS = r"[\x{0A}-\x{0D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
WITHIN = r"[\x{09}\x{1F}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
PUNCTUATION = ".,;:()[]\"'"
TAG = r"<[^>]*>"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def lines(x: Column) -> Column:
    """Stripped lines that are not empty, in order: what is left between runs of white space that hold a line boundary.
    One split of the trimmed text, without a function for each line, in linear time: a match begins at the first space of a
    run only, and gives nothing back."""
    bare = F.btrim(F.coalesce(x, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, f"(?<!{WITHIN}){WITHIN}*+{ENDS}{SPACE}*+"))


def words(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), f"{SPACE}+"), lambda y: y != "")


def tokens(x: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(words(F.lower(x)))


def coverage_words(x: Column) -> Column:
    """Distinct lower-cased words without surrounding punctuation, longer than two characters."""
    bare = F.transform(words(F.lower(x)), lambda y: F.btrim(y, F.lit(PUNCTUATION)))
    return F.array_distinct(F.filter(bare, lambda y: F.length(y) > 2))


def is_upper(x: Column) -> Column:
    """At least one cased character and none of lower case."""
    return (x == F.upper(x)) & (x != F.lower(x))


def strip_fences(x: Column) -> Column:
    """A model's answer without its Markdown code fences. The two expressions."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"(?m)^```[a-z]*\n?", ""), r"(?m)```\s*$", ""))


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '{BOUNDARY}'), lambda y: {sql_strip('y')}), lambda y: y <> '')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{SPACE}+'), lambda y: y <> '')"


def sql_tokens(x: str) -> str:
    return f"list_distinct({sql_words(f'lower({x})')})"


def sql_coverage_words(x: str) -> str:
    chars = PUNCTUATION.replace("'", "''")
    return f"list_distinct(list_filter(list_transform({sql_words(f'lower({x})')}, lambda y: trim(y, '{chars}')), lambda y: length(y) > 2))"
