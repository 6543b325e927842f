"""Secret scan: candidates, and a random forest that removes false positives. DataFrame functions only.

A candidate is a run of 16 or more characters that keys are written with, or whatever is
assigned to a name for secrets, however short and of whatever characters (run_no -1, unless
it holds such a run). What stands before a run is told by its position. A random
forest on its length, character transitions, dictionary coverage, the path it was
found under and its neighbouring words tells secrets from other long strings.

The forest is trained from labelled findings (doc_id, word_no, run_no, label). The
tables hold none, so ``seed_findings`` labels a candidate 1 if it has an issuer's
fixed format or is assigned to a name for secrets (and is more than small letters), else 0. Up to ``TRAIN_ROWS``
findings of each label are used, the smallest by a hash; findings whose
crc32(doc_id) mod ``FOLDS`` is 0 are never learnt from. The dictionary is the set of
letter triples that make up at least ``MIN_TRIPLE_SHARE`` of the triples of all
words in all texts: 26^3 at most, whatever the corpus.

Null and empty texts, and empty tables, have no candidates. Very long words are searched whole. Other columns are not looked at. Repeated rows give repeated candidates. A
null path is empty. With findings of one label only, or none, every probability
is that label's (0.5 for none).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawler.llm.frames import fold, settled

RUN = r"[A-Za-z0-9+/_-]{16,}"
SPACE = r"[\x20\x09-\x0D]+"
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,})$"
NAME = r"(?i)(?:password|passwd|pwd|secret|token|api_?key|credential)"
NAMED = NAME + r"[\"' ]*[=:]+[\"' ]*$"
#: A word up to the value it assigns, and what may stand around a value.
ASSIGNED = "^(.*?" + NAME + r"[\"']*[=:]+[\"']*)[^\"'=:]"
AROUND = r"^[\"']+|[\"',;.)]+$"
SECRET_WORD = r"(?i)(pass|pwd|secret|token|key|auth|cred|bearer)"
SAMPLE_PATH = r"(?i)(test|example|sample|mock|fixture|docs?/)"

FOLDS = 5
TRAIN_ROWS = 20_000
MIN_TRIPLE_SHARE = 1e-5
TREES, DEPTH, SEED = 40, 8, 42
THRESHOLD = 0.5

KEY = ["doc_id", "word_no", "run_no"]
FEATURES = (
    "length digits upper lower marks transitions distinct hex coverage vowels path_length path_depth "
    "path_sample slashes before_assign before_secret prefix_length previous_letters next_letters"
).split()


def triple_dictionary(docs: DataFrame, min_share: float = MIN_TRIPLE_SHARE) -> list[int]:
    """Bits of the common letter triples: triple abc is bit 676 a + 26 b + c."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text")), "[^a-z]+")).alias("word"))
    counted = words.filter(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))
    place = F.explode(F.sequence(F.lit(1), F.length("word") - 2)).alias("i")
    triples = counted.select("word", "n", place).groupBy(F.substring("word", F.col("i"), F.lit(3)).alias("t"))
    rows = triples.agg(F.sum("n").alias("n")).collect()  # 26^3 rows at most
    total = sum(r["n"] for r in rows)
    bits = [0] * 275
    for r in rows:
        if r["n"] >= min_share * total:
            a, b, c = (ord(x) - 97 for x in r["t"])
            at = 676 * a + 26 * b + c
            bits[at // 64] |= 1 << at % 64
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, word_no, run_no, run, what stands before it and after it."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(path).alias("path"), F.split("text", SPACE).alias("w"))

    def assigns(x: Column, before: Column) -> Column:
        inside = (x.contains("=") | x.contains(":")) & x.rlike(ASSIGNED)
        return inside | (before.endswith("=") | before.endswith(":"))

    near = F.filter(
        F.transform(
            "w",
            lambda x, i: F.when(
                x.rlike(RUN) | assigns(x, F.coalesce(F.get("w", i - 1), F.lit(""))),
                F.struct(
                    i.alias("word_no"),
                    x.alias("word"),
                    F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("previous"),
                    F.coalesce(F.get("w", i + 1), F.lit("")).alias("next"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    found = told.select("doc_id", "path", F.explode(near).alias("s")).select("doc_id", "path", "s.*")
    runs = found.filter(F.col("word").rlike(RUN)).select(
        "*", F.split("word", RUN, -1).alias("between"), F.regexp_extract_all("word", F.lit(f"({RUN})"), F.lit(1)).alias("runs")
    )
    runs = runs.select("*", F.posexplode("runs").alias("run_no", "run"))

    def chars(parts: str, n: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda total, x: total + F.char_length(x))

    start = chars("between", F.col("run_no") + 1) + chars("runs", F.col("run_no"))
    runs = runs.select(*KEY, "path", "run", F.substring("word", F.lit(1), start).alias("prefix"), "previous", "next")

    head = F.regexp_extract("word", ASSIGNED, 1)
    value = F.when(head != "", F.expr("substring(word, char_length(head) + 1)")).when(F.col("previous").rlike(NAMED), F.col("word"))
    named = found.withColumn("head", head).withColumn("run", F.regexp_replace(value, AROUND, ""))
    named = named.filter((F.col("run") != "") & ~F.col("run").rlike(RUN))
    named = named.withColumn("run_no", F.lit(-1)).select(*KEY, "path", "run", F.col("head").alias("prefix"), "previous", "next")
    return runs.unionByName(named)


def _coverage(run: Column, dictionary: list[int]) -> Column:
    """Share of the letter triples of a run that are in the dictionary, of all its triples."""
    bits = F.lit(dictionary)
    codes = F.transform(F.split(F.lower(run), ""), lambda c: F.ascii(c) - 97)
    after = [F.slice(codes, k, F.greatest(F.size(codes) - k + 1, F.lit(0))) for k in (2, 3)]
    triples = F.arrays_zip(codes.alias("a"), after[0].alias("b"), after[1].alias("c"))

    def told(count, t):
        # The last two triples are short: their missing letters make this null.
        letters = t["a"].between(0, 25) & t["b"].between(0, 25) & t["c"].between(0, 25)
        at = t["a"] * 676 + t["b"] * 26 + t["c"]
        bit = F.getbit(F.element_at(bits, F.floor(at / 64).cast("int") + 1), at % 64)
        return count + F.when(letters, bit.cast("int")).otherwise(0)

    return F.aggregate(triples, F.lit(0), told) / F.greatest(F.length(run) - 2, F.lit(1))


def features(found: DataFrame, dictionary: list[int]) -> DataFrame:
    """Candidates with the columns of ``FEATURES``."""
    run, n = F.col("run"), F.length("run").cast("double")

    def share(kind: str) -> Column:
        return F.length(F.regexp_replace(run, f"[^{kind}]", "")) / n

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(run, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    before = F.concat_ws(" ", "previous", "prefix")
    return found.select(
        *KEY,
        "run",
        before.alias("before"),
        n.alias("length"),
        share("0-9").alias("digits"),
        share("A-Z").alias("upper"),
        share("a-z").alias("lower"),
        share("+/_-").alias("marks"),
        (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split(run, ""))) / n).alias("distinct"),
        share("0-9a-fA-F").alias("hex"),
        _coverage(run, dictionary).alias("coverage"),
        share("aeiouAEIOU").alias("vowels"),
        F.length("path").cast("double").alias("path_length"),
        F.length(F.regexp_replace("path", "[^/]", "")).cast("double").alias("path_depth"),
        F.col("path").rlike(SAMPLE_PATH).cast("double").alias("path_sample"),
        F.length(F.regexp_replace(run, "[^/]", "")).cast("double").alias("slashes"),
        before.rlike("[=:][\"' ]*$").cast("double").alias("before_assign"),
        before.rlike(SECRET_WORD).cast("double").alias("before_secret"),
        F.length("prefix").cast("double").alias("prefix_length"),
        F.col("previous").rlike("^[A-Za-z ,.]*$").cast("double").alias("previous_letters"),
        F.col("next").rlike("^[A-Za-z,.]*$").cast("double").alias("next_letters"),
    )


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def seed_findings(featured: DataFrame) -> DataFrame:
    """Labelled findings by issuers' formats and by names for secrets."""
    secret = F.col("run").rlike(ISSUED) | (F.col("before").rlike(NAMED) & F.col("run").rlike("[^a-z]"))
    return featured.withColumn("label", secret.cast("double"))


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate: its key, masked run, length, label, held_out, probability, is_secret.

    ``findings`` (the key, label) are labelled candidates; without them the seeds are.
    """
    text = docs.filter(F.col("text").isNotNull())
    featured = settled(features(candidates(text, path), triple_dictionary(text)))
    if findings is None:
        labelled = seed_findings(featured)
    else:
        told = findings.groupBy(*KEY).agg(F.max(F.col("label").cast("double")).alias("label"))
        labelled = featured.join(told, KEY, "left")
    order = F.xxhash64(*KEY, "run")
    sample = [
        labelled.filter(~held_out() & (F.col("label") == value)).select("label", *FEATURES, order.alias("o")).orderBy("o").limit(TRAIN_ROWS)
        for value in (0.0, 1.0)
    ]
    sample = settled(sample[0].unionByName(sample[1]).drop("o").coalesce(1))
    labels = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(labels) < 2:
        scored = labelled.withColumn("probability", F.lit(labels[0] if labels else 0.5))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
        model = forest.fit(rows.transform(sample))
        scored = model.transform(rows.transform(labelled).drop("probability"))
        scored = scored.withColumn("probability", vector_to_array("probability")[1])
    return scored.select(
        *KEY,
        F.concat(F.substring("run", 1, 4), F.lit("...")).alias("masked"),
        F.col("length").cast("int").alias("length"),
        F.col("label").cast("int").alias("label"),
        held_out().alias("held_out"),
        F.round("probability", 9).alias("probability"),
        (F.col("probability") >= threshold).alias("is_secret"),
    )
