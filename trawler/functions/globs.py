"""Include and ignore globs as one regular expression per list."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types indexed when a collection names no globs.
DEFAULT_EXTENSIONS = (".md", ".markdown", ".txt", ".log")


def _translate(glob: str) -> str:
    """Shell pattern to regex; ``*`` and ``?`` never cross a slash."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2)
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and close > 0:
            out += glob[i : close + 1]
            i = close
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(ch)
        i += 1
    return out


def glob_regex(globs: list[str]) -> str | None:
    """A regex that finds paths any glob accepts; None when there are none."""
    parts = []
    for glob in (g.strip() for g in globs):
        if not glob:
            continue
        if glob == "**/*":
            parts.append("^")
            continue
        if re.fullmatch(r"\*\*/\*\.[^./*?\[]+", glob):
            parts.append("(?i:" + re.escape(glob[4:]) + ")$")
        parts.append("^" + _translate(glob) + "$")
        if glob.startswith("**/"):
            parts.append("(?:^|/)" + _translate(glob[3:]) + "$")
    return "|".join(parts) if parts else None


def matches_globs(path: Column, globs: list[str]) -> Column:
    regex = glob_regex(globs)
    return path.rlike(regex) if regex else F.lit(False)


def included(path: Column, include: list[str], ignore: list[str]) -> Column:
    if include:
        wanted = matches_globs(path, include)
    else:
        kinds = "|".join(re.escape(e) for e in DEFAULT_EXTENSIONS)
        wanted = path.rlike(f"(?i:{kinds})$")
    return wanted & ~matches_globs(path, ignore)
