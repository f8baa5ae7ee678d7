"""Globs and paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"css": "css", "scss": "scss", "sass": "sass", "less": "less", "vue": "vue", "html": "html", "htm": "html", "tsx": "typescriptreact", "jsx": "javascriptreact"}


def glob_regex(glob: str) -> str:
    """Unanchored pattern of a glob: ** is any text, * any text without a slash; ? stays a quantifier."""
    out = []
    for part in re.split(r"(\*\*|\*)", glob.replace("\\", "/")):
        out.append({"**": ".*", "*": "[^/]*"}.get(part) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", part))
    return "".join(out)


def matches_any(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    """Whether a path, with backslashes as slashes, matches one of the globs anywhere."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    # at the ends of an unanchored pattern text of any length asks for nothing, and would be tried from every letter
    asked = [re.sub(r"^(\.\*(?!\?))+|(\.\*|\[\^/\]\*)+$", "", glob_regex(g)) for g in globs]

    def found(pattern: str) -> Column:
        # most globs ask for a fixed text, which is found without a pattern
        text = re.sub(r"\\([.+^${}()|\[\]\\])", r"\1", pattern)
        return F.contains(plain, F.lit(text)) if re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", text) == pattern and "?" not in text else plain.rlike(pattern)

    return reduce(lambda a, b: a | b, [found(p) for p in asked], F.lit(False))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)\z", 1))


def is_style_file(path: Column) -> Column:
    return extension(path).isin(".css", ".scss", ".sass", ".less")


def language_of(path: Column) -> Column:
    """Editor language of a path by extension; null where unknown."""
    found = [F.when(extension(path) == f".{k}", v) for k, v in LANGUAGES.items()]
    return F.coalesce(*found)


def relative_path(path: Column, roots: tuple[str, ...] | list[str]) -> Column:
    """Path below the first root that is a prefix of it; a path outside all roots is unchanged."""
    out = path
    for root in reversed(roots):
        rest = F.regexp_replace(F.substring(path, len(root) + 1, 1 << 30), "^/+", "")
        out = F.when(F.startswith(path, F.lit(root)), rest).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*\z", 0)
