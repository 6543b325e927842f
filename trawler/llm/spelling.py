"""Groups of spelling variants by a relational walk of a trie.

Words: longest runs of Latin letters (A-Z lower-cased, nothing else); where 97
divides the CRC-32 ``h`` of ``<doc_id>:<run>``, the run loses its code point ``h %
length``. Kept are words of ``min_length`` code points and ``min_count`` occurrences.

Two words are near if one code point inserted, deleted or replaced turns one into
the other. They are found without comparing words: a frontier of states (word,
position, node, edits) goes down the trie of all words one level at a time. A
node is the prefix it stands for, and a level's edges are cut from the words by a
distributed distinct, so no task ever holds the trie. At each level every state looks
its next symbol up in the edge table (a join on node and symbols). A state without an
edit also looks up what follows after leaving its symbol out, and what follows after
another symbol in its place; such an edge spans ``AHEAD`` symbols beyond the
replaced one, so that only continuations that exist come back. A state with one
edit that reaches the end symbol has found a neighbour.

Leaving out is done at the first symbol of a run of equal ones and replacing by smaller
symbols only; the pairs are then mirrored. So each pair is found exactly once, and
inserting needs no step of its own.

Levels go as deep as ``LEVELS``. Longer words (random letters, mostly) share a half of
the shorter word, which they are joined on before an exact test: nothing is left out.

A word's form is its near word of largest count (then the first in code-point order)
if that is at least twice its own; its root is where the forms end. Counts double at
each step, so the walk by pointer doubling takes few rounds.

Null texts have no words; a null id counts as empty in the hash. Repeated rows count
as often as they are there. No words give no rows. Other columns are not looked at. A
text is held whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawler.llm.frames import settled, small

LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
MODULUS = 97
AHEAD = 3
LEVELS = 64
#: Ends every word in the trie; no letter.
END = "$"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame) -> DataFrame:
    """(run) of every run of letters, with the dealt-out deletions done."""
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("raw"),
    )
    # Most runs have no capital: what lower() leaves alone needs no translation.
    plain = F.when(F.col("raw") == F.lower("raw"), F.col("raw")).otherwise(F.translate("raw", _UPPER, _UPPER.lower()))
    hashed = found.select(plain.alias("run"), F.crc32(F.concat_ws(":", "id", plain)).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % MODULUS == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    words = runs(docs).filter(F.char_length("run") >= min_length)
    return words.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def edges(words: DataFrame) -> DataFrame:
    """(level, node, wide, other, ahead, child) of the trie of all words.

    A plain edge has one symbol in ``ahead``. A wide one first has any symbol, ``other``,
    and ``ahead`` holds the ones after it.
    """
    level = F.col("level")
    cut = words.select(F.concat("word", F.lit(END)).alias("w"), F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("level"))
    cut = cut.select("level", F.substring("w", F.lit(1), level).alias("node"), F.substring("w", level + 1, F.lit(1 + AHEAD)).alias("tail"))
    # One row per wide edge; plain ones are told apart below.
    wide = cut.distinct().select(
        "level", "node", F.lit(True).alias("wide"), F.substring("tail", 1, 1).alias("other"),
        F.substring("tail", 2, AHEAD).alias("ahead"), F.concat("node", "tail").alias("child"),
    )
    plain = wide.select("level", "node", F.col("other").alias("ahead")).distinct().select(
        "level", "node", F.lit(False).alias("wide"), F.lit("").alias("other"), "ahead", F.concat("node", "ahead").alias("child")
    )
    return wide.filter("ahead <> ''").unionByName(plain)


def step(states: DataFrame, below: DataFrame) -> DataFrame:
    """States one level on, or more behind a replaced symbol: (word, pos, node, edits, depth).

    No level stands in the expressions, so all levels run the same compiled code.
    """
    pos = F.col("pos")
    seen = states.select(
        "word", "node", "pos", "edits",
        F.substring(F.concat("word", F.lit(END)), pos + 1, F.lit(1 + AHEAD)).alias("tail"),
        F.when(pos > 0, F.substring("word", pos, F.lit(1))).otherwise(F.lit("")).alias("before"),
    )
    seen = seen.withColumn("own", F.substring("tail", 1, 1)).withColumn("rest", F.substring("tail", 2, AHEAD))
    fresh = (F.col("edits") == 0) & (F.col("rest") != "")

    def look(ahead: Column, wide: bool, forward: Column, edits: Column) -> Column:
        return F.struct(ahead.alias("ahead"), F.lit(wide).alias("wide"), (pos + forward).alias("next"), edits.alias("made"))

    one = F.lit(1)
    looked = F.array(
        look(F.col("own"), False, one, F.col("edits")),
        # Leaving a symbol out: the first of a run of equal ones only.
        F.when(fresh & (F.col("own") != F.col("before")), look(F.substring("rest", 1, 1), False, F.lit(2), one)),
        F.when(fresh, look(F.col("rest"), True, one + F.char_length("rest"), one)),
    )
    asked = seen.select("word", "node", "own", F.explode(looked).alias("q")).filter("q IS NOT NULL")
    met = asked.select("word", "node", "own", "q.*").join(below, ["node", "wide", "ahead"])
    met = met.filter(~F.col("wide") | (F.col("other") < F.col("own")))
    ended = F.endswith("child", F.lit(END))
    depth = F.when(ended, F.lit(-1)).otherwise(F.char_length("child"))
    return met.filter(~ended | (F.col("made") == 1)).select(
        "word", F.col("next").alias("pos"), F.col("child").alias("node"), F.col("made").alias("edits"), depth.alias("depth")
    )


def _trie_pairs(words: DataFrame) -> DataFrame | None:
    """(word, near) of words within ``LEVELS``, each pair one way round."""
    deepest = words.agg(F.max(F.char_length("word"))).first()[0]
    if deepest is None:
        return None
    trie = settled(edges(words).repartition("level", "node"), by=["level"])
    start = words.select("word", F.lit(0).alias("pos"), F.lit("").alias("node"), F.lit(0).alias("edits"), F.lit(0).alias("depth"))
    waiting, found = [start], []
    for level in range(deepest + 1):
        here = waiting[0].filter(F.col("depth") == level)
        for frame in waiting[1:]:
            here = here.unionByName(frame.filter(F.col("depth") == level))
        made = settled(step(here, trie.filter(F.col("level") == level).drop("level")), by=["depth"])
        found.append(made.filter("depth = -1"))
        waiting = [*waiting, made][-(AHEAD + 1) :]
    pairs = found[0]
    for frame in found[1:]:
        pairs = pairs.unionByName(frame)
    return pairs.select("word", F.expr("substring(node, 1, char_length(node) - 1)").alias("near"))


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, near) where the longer word is beyond ``LEVELS``, each pair one way round.

    One edit leaves the first half of the shorter word or all after it alone.
    """
    size = F.char_length("word")
    halves = []
    for less in (0, 1):
        length = size - less
        half = F.floor(length / 2).cast("int")
        head = F.struct(length.alias("size"), F.lit("head").alias("part"), F.substring("word", F.lit(1), half).alias("text"))
        rest = length - half
        tail = F.struct(length.alias("size"), F.lit("tail").alias("part"), F.substring("word", size - rest + 1, rest).alias("text"))
        halves += [head, tail]
    keyed = words.filter(size >= LEVELS).select("word", F.explode(F.array(*halves)).alias("k"))
    keyed = keyed.select("word", "k.size", "k.part", F.sha2("k.text", 256).alias("half"))
    a, b = keyed, keyed.withColumnRenamed("word", "near")
    one = (F.col("word") < F.col("near")) & (F.greatest(F.char_length("word"), F.char_length("near")) > LEVELS)
    met = a.join(b, ["size", "part", "half"]).filter(one & (F.levenshtein("word", "near", 1) == 1))
    return met.select("word", "near").distinct()


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near) of all pairs of near words in the settled ``words`` (word), both ways round."""
    longest = words.select(F.max(F.char_length("word"))).first()[0] or 0
    pairs = _trie_pairs(words.filter(F.char_length("word") <= LEVELS))
    if longest > LEVELS:
        long = _long_pairs(words)
        pairs = long if pairs is None else pairs.unionByName(long)
    if pairs is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    both = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word in ``forms`` (word, form)."""
    now = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        above = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        later = now.join(small(above), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = settled(later)
        moved = now.filter("moved").isEmpty()
        now = now.select("word", "root")
        if moved:
            return now


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = settled(vocabulary(docs, min_length, min_count))
    pairs = near_pairs(words.select("word"))
    known = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    told = words.join(best, "word", "left").withColumn("best_n", -F.col("best.less"))
    doubled = F.col("best_n") >= 2 * F.col("n")
    told = settled(
        told.select(
            "word",
            F.when(doubled, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(doubled, F.col("best_n")).alias("form_n"),
        )
    )
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
