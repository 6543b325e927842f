"""Driver-side reading of a search string into clauses.

A query is a scalar, so this runs once on the driver; the clauses it returns
become predicates on the postings table.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from trawler.functions.stem import stem_word
from trawler.functions.text import fold_alphabet

# Words ignored by the any-term query unless nothing else is left.
STOP_WORDS = frozenset(
    """a an the is are was were be been being have has had do does did will would
    could should may might shall can of in to for with on at by from as and or not
    but it its this that these those""".split()
)

_TOKEN = re.compile(r'(-?)(?:"([^"]*)"?|([^\s"]+))')


def _is_cjk(ch: str) -> bool:
    if "぀" <= ch <= "ヿ":
        return True
    name = unicodedata.name(ch, "")
    return name.startswith(("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HANGUL", "CJK RADICAL",
                            "KANGXI RADICAL", "IDEOGRAPHIC ITERATION", "IDEOGRAPHIC NUMBER"))


def _is_word(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LN"


def _keep_term(text: str) -> str:
    return "".join(ch for ch in text.lower() if _is_word(ch) or ch in "'_")


def _keep_phrase(text: str) -> str:
    spaced = "".join(f" {ch} " if _is_cjk(ch) else ch for ch in text)
    return " ".join(filter(None, map(_keep_term, spaced.split())))


def word_tokens(text: str) -> list[str]:
    """The tokens the index holds for a piece of query text."""
    src, dst = fold_alphabet()
    table = {ord(ch): (dst[i] if i < len(dst) else None) for i, ch in enumerate(src)}
    out, run = [], ""
    for ch in text.lower().translate(table) + " ":
        if _is_cjk(ch):
            out += [run, ch]
            run = ""
        elif unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co":
            run += ch
        else:
            out.append(run)
            run = ""
    return [t for t in out if t]


@dataclass(frozen=True)
class Clause:
    """Tokens that must follow each other; ``prefix`` opens the last one."""

    text: str
    prefix: bool = False

    def tokens(self, stemmer: str) -> tuple[str, ...]:
        return tuple(stem_word(t, stemmer) for t in word_tokens(self.text))

    def __str__(self):
        return f'"{self.text}"' + ("*" if self.prefix else "")


@dataclass(frozen=True)
class LexQuery:
    """Required clauses, excluded groups, and whether one hit is enough."""

    required: tuple[Clause, ...] = ()
    excluded: tuple[tuple[Clause, ...], ...] = ()
    any_clause: bool = False

    def __bool__(self):
        return bool(self.required)

    def __str__(self):
        if not self.required:
            return ""
        text = (" OR " if self.any_clause else " AND ").join(map(str, self.required))
        for group in self.excluded:
            inner = " AND ".join(map(str, group))
            text += f" NOT ({inner})" if len(group) > 1 else f" NOT {inner}"
        return text


def _clauses(text: str, quoted: bool) -> tuple[Clause, ...]:
    text = text.strip().lower()
    dotted = text.split(".")
    if quoted:
        found = [Clause(_keep_phrase(text))]
    elif (
        len(text) >= 3
        and "-" in text[1:-1]
        and _is_word(text[0])
        and _is_word(text[-1])
        and all(_is_word(ch) or ch in "-'" for ch in text)
    ):
        found = [Clause(" ".join(filter(None, map(_keep_term, text.split("-")))))]
    elif len(dotted) > 1 and all(p and all(_is_word(c) or c == "_" for c in p) for p in dotted):
        found = [Clause(_keep_term(p), prefix=True) for p in dotted]
    elif any(map(_is_cjk, text)):
        found = [Clause(_keep_phrase(text))]
    else:
        found = [Clause(_keep_term(text), prefix=True)]
    return tuple(c for c in found if c.text)


def parse(query: str) -> LexQuery:
    """All positive terms are required, ``-term`` excludes, quotes keep order."""
    required, excluded = [], []
    for minus, phrase, word in _TOKEN.findall(query.strip()):
        group = _clauses(word or phrase, quoted=not word)
        if group and minus:
            excluded.append(group)
        elif group:
            required.extend(group)
    return LexQuery(tuple(required), tuple(excluded)) if required else LexQuery()


def parse_any(query: str) -> LexQuery:
    """One matching word is enough; stop words count only when alone."""
    words = []
    for raw in query.lower().split():
        word = "".join(
            ch for ch in raw if (ch.isascii() and (ch.isalnum() or ch in "-_")) or _is_cjk(ch)
        )
        if word:
            words.append(word)
    kept = [w for w in words if w not in STOP_WORDS] or words
    return LexQuery(tuple(Clause(w, prefix=True) for w in kept), any_clause=True)
