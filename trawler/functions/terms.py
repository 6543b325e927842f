"""Query terms for picking the best passage, and model-output readers."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of an intent text that say nothing about its subject.
INTENT_STOP_WORDS = frozenset(
    """am an as at be by do he if in is it me my no of on or so to up us we all and any
    are but can did for get has her him his how its let may not our out the too was who
    why you also does find from have into more need show some tell that them this want
    what when will with your about looking notes search where which""".split()
)
# Fixed value: characters cut from both ends of a question term.
QUESTION_TRIM = "_./,;:!?()[]{}\"'"

EXPANSION_KINDS = ("lex", "vec", "hyde")


def question_terms(text: str) -> list[str]:
    """Lower-case words of three or more bytes, repeats kept."""
    words = (w.strip(QUESTION_TRIM) for w in text.lower().split())
    return [w for w in words if len(w.encode("utf-8")) >= 3]


def intent_terms(text: str) -> list[str]:
    words = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.lower().split())
    return [w for w in words if len(w.encode("utf-8")) > 1 and w not in INTENT_STOP_WORDS]


def overlap_score(content: Column, question: str, intent: str = "") -> Column:
    """2 for every question term the text contains, 1 for every intent term."""
    low = F.lower(content)
    hits = [F.contains(low, F.lit(t)).cast("int") * 2 for t in question_terms(question)]
    hits += [F.contains(low, F.lit(t)).cast("int") for t in intent_terms(intent)]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def rerank_question(question: str, intent: str = "") -> str:
    intent = intent.strip()
    return f"{intent}\n\n{question}" if intent else question


def rerank_score(output: Column) -> Column:
    """A yes/no/number answer as a score in [0, 1]; "yes" wins, then "no"."""
    low = F.lower(output)
    number = F.regexp_extract(output, r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)", 0)
    value = F.coalesce(number.try_cast("double"), F.lit(0.0))
    return (
        F.when(F.contains(low, F.lit("yes")), 1.0)
        .when(F.contains(low, F.lit("no")), 0.0)
        .otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    )


def has_negation(text: str) -> bool:
    """Whether any word starts with a minus sign."""
    return re.search(r"(?:^|\s)-", text) is not None


def parse_expansions(output: str) -> list[tuple[str, str]]:
    """(kind, text) of every ``kind: text`` line with a known kind."""
    found = []
    for line in output.split("\n"):
        kind, colon, text = line.strip().partition(":")
        kind = kind.strip().lower()
        if colon and text.strip() and kind in EXPANSION_KINDS:
            found.append((kind, text.strip()))
    return found


def parse_embedding(output: str | bytes) -> list[float]:
    """The first vector in an embedding program's JSON output, whatever the
    shape: ``embedding``, ``embeddings[0]``, ``data[0].embedding``, a list of
    such objects, a matrix, or a plain vector."""
    text = output.decode("utf-8") if isinstance(output, bytes) else output
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    end = max(text.rfind("}"), text.rfind("]"))
    if not starts or end < min(starts):
        raise ValueError("no JSON in embedding output")
    node = json.loads(text[min(starts) : end + 1])
    while node:
        if isinstance(node, dict):
            node = node.get("embedding") or node.get("embeddings") or node.get("data")
        elif isinstance(node[0], (int, float)):
            return [float(x) for x in node]
        else:
            node = node[0]
    raise ValueError("empty embedding in output")
