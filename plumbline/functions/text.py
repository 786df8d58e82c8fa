"""Column functions over text. Python regular expressions know Unicode, so Java's get (?U)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
INFERENTIAL_SIGNALS = (
    "trend", "trajectory", "suggests", "indicates", "on track", "at risk", "appears to", "likely", "projected", "based on",
    "derived from", "analysis shows", "pattern", "forecast", "outlook", "implies", "consistent with", "points to", "expected to",
)
PRONOUNS = ("it", "he", "she", "they", "this", "that", "these", "those", "its", "their")
ATOM_BREAK = r"(?U)(?<!\d)[.!?](?!\d)\s+|\n+"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda s: s != "")


def atoms(claim: Column) -> Column:
    """A claim's sentences: terminators are dropped, those between digits do not end one."""
    return _pieces(claim, ATOM_BREAK)


def sentences(answer: Column) -> Column:
    """An answer's sentences, terminators kept."""
    return _pieces(answer, SENTENCE_BREAK)


def claim_type(sentence: Column) -> Column:
    """Inferential if a signal occurs as whole words."""
    signal = r"(?U)\b(?:" + "|".join(map(re.escape, INFERENTIAL_SIGNALS)).replace(r"\ ", " ") + r")\b"
    return F.when(F.lower(sentence).rlike(signal), "Inferential").otherwise("Extractive")


def classified_atoms(claim: Column) -> Column:
    return F.transform(atoms(claim), lambda s: F.struct(s.alias("claim_text"), claim_type(s).alias("claim_type")))


def starts_with_pronoun(sentence: Column) -> Column:
    first = F.regexp_replace(F.get(words(sentence), F.lit(0)), r"[.,!?]+$", "")
    return F.coalesce(F.lower(first).isin(*PRONOUNS), F.lit(False))


def approx_tokens(c: Column) -> Column:
    """1.3 for each word, halves to even."""
    return F.bround(F.size(words(c)) * F.lit(1.3).cast("decimal(4,1)"), 0).cast("long")


def strip_fences(c: Column) -> Column:
    """The first fenced block if it looks like JSON, else the text, stripped."""
    inner = strip(F.regexp_extract(c, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1))
    return F.when(inner.startswith("{") | inner.startswith("["), inner).otherwise(strip(c))


def strip_think(c: Column) -> Column:
    """Without a model's thoughts: what follows the last closing tag; nothing where one is left open."""
    after = F.regexp_extract(c, r"(?is)^.*</think[^>]*>(.*)$", 1)
    rest = strip(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    unclosed = F.lower(F.ltrim(c)).startswith("<think") & (rest == strip(c))
    return F.when(c.rlike(r"(?is)^.*</think[^>]*>"), strip(after)).when(unclosed, "").otherwise(rest)


def json_substring(c: Column) -> Column:
    """From the first bracket to the last one that closes its kind."""
    brace, bracket = F.instr(c, "{"), F.instr(c, "[")
    curly = (brace > 0) & ((bracket == 0) | (brace < bracket))
    start = F.when(curly, brace).otherwise(bracket)
    last = lambda ch: F.length(c) - F.instr(F.reverse(c), ch) + 1
    end = F.when(curly, F.when(F.instr(c, "}") > 0, last("}"))).otherwise(F.when(F.instr(c, "]") > 0, last("]")))
    return F.when((start > 0) & (end > start), strip(F.substring(c, start, end - start + 1))).otherwise(strip(c))


def flattened(c: Column, kind: T.DataType, prefix: str | Column = "") -> Column:
    """Nested values as `a.b[0].c: value` lines, depth first; null and booleans as None, True, False."""
    at = F.lit(prefix) if isinstance(prefix, str) else prefix
    if isinstance(kind, T.StructType):
        lines = []
        for f in kind.fields:
            name = F.lit(f.name) if isinstance(prefix, str) and not prefix else F.concat(at, F.lit(f".{f.name}"))
            lines.append(flattened(c[f.name], f.dataType, name))
        body = F.array_join(F.filter(F.array(*lines), lambda x: x != ""), "\n") if lines else F.lit("")
        return F.when(c.isNull(), F.concat(at, F.lit(": None"))).otherwise(body)
    if isinstance(kind, T.ArrayType):
        each = F.transform(c, lambda x, i: flattened(x, kind.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        body = F.array_join(F.filter(each, lambda x: x != ""), "\n")
        return F.when(c.isNull(), F.concat(at, F.lit(": None"))).otherwise(body)
    value = c.cast("string")
    if isinstance(kind, T.BooleanType):
        value = F.when(c, "True").otherwise("False")
    return F.concat(at, F.lit(": "), F.when(c.isNull(), "None").otherwise(value))
