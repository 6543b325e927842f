"""Column functions for text: tokens, titles, snippets, ids, slugs."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawler.config import SNIPPET_CHARS

# The scripts indexed one character per token, as a regex class body.
CJK_CLASS = r"\p{IsHan}\p{IsHangul}\x{3040}-\x{30FF}"
# Letters, numbers and private-use characters form tokens.
TOKEN_CLASS = r"\p{L}\p{N}\p{Co}"

# No CJK character lies below U+1100, so common text never reaches the slow
# script tests of the last alternatives.
TOKEN_REGEX = (
    rf"(?:[a-z0-9]++|[\x{{80}}-\x{{10FF}}&&[{TOKEN_CLASS}]]"
    rf"|[\x{{1100}}-\x{{10FFFF}}&&[{TOKEN_CLASS}]&&[^{CJK_CLASS}]])++"
    rf"|[\x{{1100}}-\x{{10FFFF}}&&[{CJK_CLASS}]]"
)
SPACE_REGEX = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# The combining marks the tokenizer skips inside a word, given as
# bit masks over U+0300..U+031F and U+0320..U+033F.
_MARK_MASKS = (0x08029FDF, 0x000361F8)


@lru_cache(maxsize=1)
def fold_alphabet() -> tuple[str, str]:
    """(from, to) strings for ``translate``: single-accent Latin letters to
    their base letter, then the skipped combining marks, which are deleted."""
    src, dst = [], []
    for code in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and parts[0].isascii() and char == char.lower():
            src.append(char)
            dst.append(parts[0])
    marks = [
        chr(0x300 + bit)
        for bit in range(64)
        if _MARK_MASKS[bit // 32] >> (bit % 32) & 1
    ]
    return "".join(src + marks), "".join(dst)


def fold(col: Column) -> Column:
    """Lower-case and remove accents; pure ASCII text skips the second step."""
    src, dst = fold_alphabet()
    low = F.lower(col)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, src, dst))


def tokens(col: Column) -> Column:
    """Folded tokens in order; every CJK character is a token of its own."""
    return F.regexp_extract_all(fold(F.coalesce(col, F.lit(""))), F.lit(TOKEN_REGEX), F.lit(0)).alias("tokens")


def trim_space(col: Column) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.regexp_replace(col, f"^{SPACE_REGEX}+|{SPACE_REGEX}+$", "")


def collapse_space(col: Column) -> Column:
    return trim_space(F.regexp_replace(col, f"{SPACE_REGEX}+", " "))


def space_cjk(col: Column) -> Column:
    """Blank-separate CJK characters, the form written for display indexes."""
    return F.regexp_replace(col, f"([{CJK_CLASS}])", " $1 ")


def split_scripts(col: Column) -> Column:
    """Put a blank wherever CJK text meets other text."""
    cjk = rf"[{CJK_CLASS}]"
    edges = F.regexp_replace(col, rf"(?<={cjk})(?!{cjk})|(?<!{cjk})(?={cjk})", " ")
    return F.when(has_cjk(col), edges).otherwise(col)


def has_cjk(col: Column) -> Column:
    return col.rlike(f"[{CJK_CLASS}]")


def estimate_tokens(col: Column) -> Column:
    """1.5 tokens per CJK character, a quarter for any other."""
    scripts = r"[\p{IsHan}\p{IsHangul}\p{IsKatakana}\p{IsHiragana}]"
    cjk = F.regexp_count(col, F.lit(rf"[\x{{1100}}-\x{{10FFFF}}&&{scripts}]"))
    other = F.char_length(col) - cjk
    return F.floor(cjk * 1.5).cast("int") + F.floor(other / 4).cast("int")


def shorten(col: Column, chars: int, ellipsis: str = "") -> Column:
    cut = F.concat(F.substring(col, 1, chars), F.lit(ellipsis))
    return F.when(F.char_length(col) <= chars, col).otherwise(cut)


def _head(col: Column) -> Column:
    """The text up to its 181st visible character: all a snippet can show."""
    return F.regexp_extract(col, rf"^(?:{SPACE_REGEX}*+[^\s]){{0,{SNIPPET_CHARS + 1}}}", 0)


def snippet(col: Column) -> Column:
    return shorten(collapse_space(_head(col)), SNIPPET_CHARS, "...")


def display_snippet(col: Column) -> Column:
    """Snippet of a lexical hit, where CJK and other text stand apart."""
    return shorten(collapse_space(split_scripts(_head(col))), SNIPPET_CHARS, "...")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_of_path(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def title(text: Column, path: Column) -> Column:
    """First ``# `` heading, else the file name without extension."""
    heading = F.regexp_extract(text, r"(?md)^[ \t\r\f\x0B]*+#\x20[ \t\r\f\x0B]*+([^\n]+)", 1)
    found = trim_space(heading)
    return F.when(F.char_length(found) > 0, found).otherwise(stem_of_path(path))


def slug(col: Column) -> Column:
    dashed = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def document_id(collection: Column, rel_path: Column) -> Column:
    key = F.concat(collection, F.lit("\x00"), rel_path)
    return F.concat(collection, F.lit(":"), F.substring(F.sha1(key.cast("binary")), 1, 12))


def content_hash(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def short_hash(col: Column) -> Column:
    return F.substring(col, 1, 6)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit(":c"), index.cast("string"))


def document_uri(scheme: str, collection: Column, rel_path: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), collection, F.lit("/"), rel_path)


def pipe_cell(col: Column) -> Column:
    """A value made safe for a cell of a pipe table."""
    flat = F.regexp_replace(col, "\r\n|\n", " ")
    return trim_space(F.replace(flat, F.lit("|"), F.lit("\\|")))
