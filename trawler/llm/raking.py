"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in tokens by cell (source, language, topic). The cells are
raked: a factor per source, language and topic is adjusted in turn until the
weighted tokens match the target share of every source, language and topic. A
document's weight is the product of its three factors; its probability is the
weight times a scale, at most one, where the scale makes the expected tokens of the
sample ``budget`` of the corpus. A hash of its id and text decides, so a sample is
repeatable and grows with the budget.

Targets are shares by value; a margin without given shares gets its own token
shares to the power ``POWER[margin]`` (below one lifts small values). Given values
without documents are left out, values without a given share keep their own
share, and the shares are scaled to one. Topics are the first of ``TOPICS``
whose pattern the text matches, else ``prose``.

Only cells are raked: the documents are read once to count them and once to give
out weights. Counting combines before the shuffle and the factor tables are
joined by size, so a source with a third of all rows needs no care. Each sweep
is written to the shared folder; factors meet on the driver only as one number.

Null and empty values of a column are one value. Null and empty texts have no
tokens; they are drawn with the weight of their cell. A value without tokens
keeps factor one. Repeated rows share a hash and stand or fall together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawler.llm.frames import fold, settled, small

MARGINS = ("source", "lang", "topic")
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.5
SWEEPS = 12
SCALE_STEPS = 8

#: Topic name, what a text must match, in this order, and what any match holds (looked for first).
TOPICS = (
    ("licensing", r"(?i)licensed under|all rights reserved|copyright", ""),
    ("credentials", r"AKIA[0-9A-Z]{16}|(?i:password=|token = )", ""),
    ("contacts", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2}", "@"),
    ("tables", r"\|[^|\n]*\|", "|"),
)


def topic(text: Column, topics=TOPICS) -> Column:
    found = None
    for name, pattern, holds in topics:
        hit = text.contains(holds) & text.rlike(pattern) if holds else text.rlike(pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return F.coalesce(found, F.lit("prose")) if found is not None else F.lit("prose")


def with_cells(docs: DataFrame, topics=TOPICS, carry=()) -> DataFrame:
    """doc_id, the margins, n_tokens (words) and the draw of every row, and ``carry``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(fold("doc_id"), F.lit("|"), text).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        fold("source").alias("source"),
        fold("lang").alias("lang"),
        topic(text, topics).alias("topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        draw.alias("draw"),
        *carry,
    )


def _targets(cells: DataFrame, margin: str, given: dict[str, float] | None) -> DataFrame:
    """value, target: wanted share of the tokens."""
    own = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("n").alias("n")).filter("n > 0")
    total = own.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") / F.lit(float(total or 1))
    wanted = F.pow(share, F.lit(POWER[margin]))
    if given:
        named = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        wanted = F.coalesce(named[F.col("value")].cast("double"), share)
    told = settled(own.select("value", wanted.alias("wanted")))
    whole = told.agg(F.sum("wanted")).first()[0] or 1.0
    return settled(told.select("value", (F.col("wanted") / F.lit(whole) * F.lit(float(total))).alias("target")))


def _weighted(cells: DataFrame, factors: dict[str, DataFrame], but: str = "") -> DataFrame:
    """Cells with the product of their factors, leaving one margin out."""
    out = cells
    for margin, table in factors.items():
        if margin != but:
            out = out.join(table.select(F.col("value").alias(margin), F.col("factor").alias(f"_{margin}")), margin, "left")
    product = reduce(lambda a, b: a * b, [F.coalesce(F.col(f"_{m}"), F.lit(1.0)) for m in factors if m != but], F.lit(1.0))
    return out.withColumn("weight", product).drop(*[f"_{m}" for m in factors])


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> dict[str, DataFrame]:
    """Factor tables (value, factor) by margin, from cells (the margins, n)."""
    wanted = {m: small(_targets(cells, m, (targets or {}).get(m))) for m in MARGINS}
    factors = {m: wanted[m].select("value", F.lit(1.0).alias("factor")) for m in MARGINS}
    for _ in range(sweeps):
        for margin in MARGINS:
            there = _weighted(cells, factors, margin).groupBy(F.col(margin).alias("value"))
            there = there.agg(F.sum(F.col("n") * F.col("weight")).alias("there"))
            factor = F.when(F.col("there") > 0, F.col("target") / F.col("there")).otherwise(F.lit(1.0))
            step = there.join(wanted[margin], "value").select("value", factor.alias("factor"))
            factors[margin] = small(settled(step))
    return factors


def sampling_scale(cells: DataFrame, budget: float, steps: int = SCALE_STEPS) -> float:
    """The scale at which sum(n * min(1, scale * weight)) is ``budget`` of sum(n).

    Starts where nothing is cut and shares out what the cut leaves, until no more
    cells reach probability one.
    """
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("w")).first()
    if not total["n"] or not total["w"]:
        return 1.0
    want = budget * total["n"]
    scale = want / total["w"]
    for _ in range(steps):
        full = F.col("weight") * F.lit(scale) >= 1
        row = cells.agg(
            F.sum(F.when(full, F.col("n"))).alias("full"), F.sum(F.when(~full, F.col("n") * F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        scale = max(scale, (want - (row["full"] or 0)) / row["open"])
    return scale


def calibrated(rows: DataFrame, targets=None, budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """Weight and probability of every cell of ``rows`` (the margins, n_tokens)."""
    cells = settled(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")))
    weighted = settled(_weighted(cells, rake(cells, targets, sweeps)))
    probability = F.least(F.lit(1.0), F.col("weight") * F.lit(sampling_scale(weighted, budget)))
    return weighted.select(*MARGINS, "weight", probability.alias("probability"))


def mix_sources(docs: DataFrame, targets=None, budget: float = BUDGET, topics=TOPICS, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, the margins, n_tokens, weight, probability and sampled of every row."""
    rows = settled(with_cells(docs, topics))
    drawn = rows.join(small(calibrated(rows, targets, budget, sweeps)), list(MARGINS))
    return drawn.select(
        "doc_id",
        *MARGINS,
        "n_tokens",
        F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"),
        (F.col("draw") < F.col("probability")).alias("sampled"),
    )
