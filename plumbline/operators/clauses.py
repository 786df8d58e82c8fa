"""Legal clauses: active voice, obligation, modifiers and defined terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import strip

# Fixed values.
MODALS = ("shall not", "shall", "may not", "may", "must")
MODIFIER = r"(?iU)(?:as defined in|pursuant to|subject to|in accordance with|as set forth in)\s+[^,\.]+"
TERM = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
NOT_TERMS = "This That These Those The Each Any All Such Said When Where Which With Upon After Before During Within Without Unless Until".split()
_PASSIVE = (
    (r"(?i)^(.+?)\s+shall not be exceeded by\s+(.+?)\.?\s*$", "$2 shall not exceed $1"),
    (r"(?i)^(.+?)\s+shall be determined by\s+(.+?)\.?\s*$", "$2 shall determine $1"),
    (r"(?i)^(.+?)\s+is defined as\s+(.+?)\s+in\s+(.+?)\.?\s*$", "$3 defines $1 as $2"),
)


def active_voice(c: Column) -> Column:
    """The first passive form that fits, turned; other clauses as they are."""
    out, trimmed = None, strip(c)
    for pattern, turned in _PASSIVE:
        fits, new = trimmed.rlike(pattern), F.regexp_replace(trimmed, pattern, turned)
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return out.otherwise(c)


def modal(active: Column) -> Column:
    out = None
    for m in MODALS:
        fits = active.rlike(rf"(?iU)\b{m}\b")
        out = F.when(fits, m) if out is None else out.when(fits, m)
    return out


def modifiers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(MODIFIER), F.lit(0)), strip)


def defined_terms(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(TERM), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*NOT_TERMS) & (F.length(t) >= 4)))


def decompose(clauses: DataFrame, text: str = "clause") -> DataFrame:
    """clauses with main_proposition, modal_operator, subordinate_modifiers, defined_terms."""
    c = F.col(text)
    active = active_voice(c)
    return clauses.withColumns({"main_proposition": active, "modal_operator": modal(active), "subordinate_modifiers": modifiers(c), "defined_terms": defined_terms(c)})


def obligation_context() -> Column:
    """What a model is told about a decomposed clause."""
    listed = F.concat(F.lit("["), F.array_join(F.transform("subordinate_modifiers", lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", "), F.lit("]"))
    return F.concat(F.lit("Clause modifiers: "), listed, F.lit("\nObligation type: "), F.coalesce("modal_operator", F.lit("unknown")))


def term_sources(decomposed: DataFrame, terms: DataFrame) -> DataFrame:
    """clause_id with the definition of each of its terms, in order: an equi-join on the lower-cased term."""
    used = decomposed.select("clause_id", "corpus_id", F.posexplode("defined_terms").alias("ord", "used"))
    return used.withColumn("term", F.lower("used")).join(terms.select("corpus_id", "term", "source_id", "content"), ["corpus_id", "term"]).drop("used")
