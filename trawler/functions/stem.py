"""English suffix stripping after M. F. Porter, "An algorithm for suffix
stripping" (1980), used the way full-text tokenizers apply it: only tokens of
3 to 64 bytes are stemmed.

An index stems by a rewrite table: its distinct terms go through the steps as column
expressions, and only terms that change are joined to the occurrences. ``porter`` does
the same to the few words of a search string."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published rules as (suffix, replacement).
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

MIN_BYTES, MAX_BYTES = 3, 64


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel).

    A letter beyond ASCII is two consonants, for the bytes it has in the tokenizer.
    """
    shape = ""
    for i, ch in enumerate(word):
        if ch > "\x7f":
            shape += "cc"
        elif ch in "aeiou" or (ch == "y" and i and shape[-1] == "c"):
            shape += "v"
        else:
            shape += "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, rules, min_measure: int) -> str:
    """Apply the longest suffix rule that fits."""
    fitting = (r for r in rules if word.endswith(r[0]) and len(word) > len(r[0]))
    best = max(fitting, key=lambda r: len(r[0]), default=None)
    if best:
        stem = word[: -len(best[0])]
        if _measure(stem) >= min_measure:
            return stem + best[1]
    return word


@lru_cache(maxsize=1 << 18)
def porter(word: str) -> str:
    if not MIN_BYTES <= len(word.encode("utf-8")) <= MAX_BYTES:
        return word

    if (len(word) > 4 and word.endswith("sses")) or (len(word) > 3 and word.endswith("ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if len(word) > 3 and word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for ending in ("ed", "ing"):
            stem = word[: -len(ending)]
            if word.endswith(ending) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    stem += "e"
                elif len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz":
                    stem = stem[:-1]
                elif _measure(stem) == 1 and _ends_cvc(stem):
                    stem += "e"
                word = stem
                break

    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"

    word = _swap(word, STEP_2, 1)
    word = _swap(word, STEP_3, 1)

    suffix = max((s for s in STEP_4 if word.endswith(s) and len(word) > len(s)), key=len, default="")
    if suffix:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st"):
            word = stem

    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


# --- the same steps over a column of distinct terms ---------------------------------


def _shapes(word: Column) -> Column:
    """``_shape``: a y at the start or after a vowel is a consonant, then they take turns."""
    plain = F.regexp_replace(word, r"[^\x00-\x7F]", "cc")
    marked = F.regexp_replace(F.regexp_replace(plain, "[^aeiouy]", "c"), "[aeiou]", "v")
    turned = F.regexp_replace(F.regexp_replace(marked, "^y", "c"), "vy", "vc")
    return F.replace(F.regexp_replace(turned, "yy", "vc"), F.lit("y"), F.lit("v"))


def _measures(stem: Column) -> Column:
    return F.regexp_count(_shapes(stem), F.lit("v+c+"))


def _cvc(stem: Column) -> Column:
    return _shapes(stem).endswith("cvc") & ~stem.rlike("[wxy]$")


def _less(word: Column, chars: int) -> Column:
    return F.substring(word, F.lit(1), F.char_length(word) - chars)


def _ending(rules) -> str:
    """The longest ending that leaves something before it."""
    return f"(?s)^(.+?)({'|'.join(rules)})$"


def _swapped(rows: DataFrame, rules) -> DataFrame:
    pattern = _ending([r[0] for r in rules])
    named = F.create_map(*[F.lit(x) for r in rules for x in r])
    split = rows.withColumn("s", F.regexp_extract("w", pattern, 1)).withColumn("e", F.regexp_extract("w", pattern, 2))
    fits = (F.col("e") != "") & (_measures(F.col("s")) >= 1)
    return split.withColumn("w", F.when(fits, F.concat("s", named[F.col("e")])).otherwise(F.col("w")))


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of every row of ``terms`` (term)."""
    w, s, e = F.col("w"), F.col("s"), F.col("e")
    long = F.char_length("w") > 3
    rows = terms.select("term", F.col("term").alias("w"))
    rows = rows.withColumn(
        "w",
        F.when(w.rlike("(?s).sses$") | (long & w.endswith("ies")), _less(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _less(w, 1))
        .otherwise(w),
    )

    eed = long & w.endswith("eed")
    rows = rows.withColumn("s", F.when(~eed, F.regexp_extract("w", "(?s)^(.*)(?:ed|ing)$", 1)).otherwise(F.lit("")))
    twin = s.rlike(r"([^aeioulsz])\1$")
    mended = (
        F.when(s.rlike("(?:at|bl|iz)$"), F.concat("s", F.lit("e")))
        .when(twin, _less(s, 1))
        .when((_measures(s) == 1) & _cvc(s), F.concat("s", F.lit("e")))
        .otherwise(s)
    )
    rows = rows.withColumn(
        "w",
        F.when(eed, F.when(_measures(_less(w, 3)) > 0, _less(w, 1)).otherwise(w))
        .when(_shapes(s).contains("v"), mended)
        .otherwise(w),
    )
    rows = rows.withColumn(
        "w", F.when(w.endswith("y") & _shapes(_less(w, 1)).contains("v"), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)
    )
    rows = _swapped(_swapped(rows, STEP_2), STEP_3)

    pattern = _ending(STEP_4)
    rows = rows.withColumn("s", F.regexp_extract("w", pattern, 1)).withColumn("e", F.regexp_extract("w", pattern, 2))
    cut = (e != "") & (_measures(s) > 1) & ((e != "ion") | s.rlike("[st]$"))
    rows = rows.withColumn("w", F.when(cut, s).otherwise(w))

    rows = rows.withColumn("s", _less(w, 1)).withColumn("m", _measures(F.col("s")))
    last_e = w.endswith("e") & ((F.col("m") > 1) | ((F.col("m") == 1) & ~_cvc(s)))
    rows = rows.withColumn("w", F.when(last_e, s).otherwise(w))
    rows = rows.withColumn("w", F.when(w.endswith("ll") & (_measures(_less(w, 1)) > 1), _less(w, 1)).otherwise(w))
    size = F.octet_length("term")
    return rows.select("term", F.when((size >= MIN_BYTES) & (size <= MAX_BYTES), w).otherwise(F.col("term")).alias("stem"))


def stem_word(word: str, stemmer: str) -> str:
    return porter(word) if stemmer == "porter" else word
