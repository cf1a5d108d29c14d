"""Text functions as native column expressions.

Java regular expressions need flags to agree with the usual Unicode reading of the same patterns:
``(?U)`` for word, digit and space classes, ``(?d)`` so that only ``\\n`` ends a line. 0x1C-0x1F count as space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alternatives, in matching order.
TOKEN_PATTERN = r"[A-Za-z_]\w*|\d+|==|!=|<=|>=|[\(\)\[\]\{\}\.,:;\+\-\*/%<>]"
SPACE = r"[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """All tokens, in order, with repeats."""
    return F.regexp_extract_all(_col(text), F.lit("(?U)" + TOKEN_PATTERN), F.lit(0))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokenize(text))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def squeeze_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){SPACE}+", " ")


def normalize_lines(text: Column | str) -> Column:
    """Per line: comment removed, trimmed, white space squeezed; empty lines removed."""
    lines = F.split(_col(text), "\n", -1)
    cleaned = F.transform(lines, lambda x: squeeze_space(strip_space(F.regexp_replace(x, r"(?d)#.*$", ""))))
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "\n")


def normalize_literals(text: Column | str) -> Column:
    """Comments removed, string literals and whole numbers replaced by placeholders, white space squeezed."""
    out = F.regexp_replace(_col(text), r"(?md)#.*$", "")
    out = F.regexp_replace(out, '"[^"]*"', '"STR"')
    out = F.regexp_replace(out, "'[^']*'", "'STR'")
    out = F.regexp_replace(out, r"(?U)\b\d+\b", "0")
    return strip_space(squeeze_space(out))



def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_file(path: Column | str) -> Column:
    """File named `test_*` or `*_test.py`, or any parent folder named exactly `test` / `tests`."""
    parts = F.split(F.lower(F.regexp_replace(_col(path), "/+$", "")), "/")
    name = F.element_at(parts, -1)
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return name.startswith("test_") | name.endswith("_test.py") | F.arrays_overlap(
        parents, F.array(F.lit("test"), F.lit("tests"))
    )


def is_private(name: Column | str) -> Column:
    return _col(name).startswith("_")


def percent_text(score: Column) -> Column:
    """Score as text with one decimal, for people to read."""
    return F.format_string("%.1f%%", score * 100.0)


def glob_to_regex(glob: str) -> str:
    """Path glob as a regular expression: `**/` any folders, `*` and `?` stay inside one folder name."""
    special = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out, rest = "", glob
    while rest:
        token = next((g for g in special if rest.startswith(g)), None)
        if token:
            out, rest = out + special[token], rest[len(token):]
        else:
            out, rest = out + (rest[0] if rest[0].isalnum() or rest[0] in "_/" else "\\" + rest[0]), rest[1:]
    return f"^{out}$"
