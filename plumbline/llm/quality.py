"""Quality rules whose thresholds keep false rejections within a stated risk.

Each rule compares one statistic of a text with a cutoff. Labelled documents of good quality are the holdout. A
cutoff at a document of the holdout spends one block: by Tukey's statistically equivalent blocks, the chance that
a new good document falls above any of the cutoffs of k blocks together is Beta(k, n - k + 1), whatever the
statistics' distributions and however they depend on each other; ties and overlaps only lessen it. So each stratum
spends, over all its rules together, the most blocks whose chance is at most RISK at confidence 1 - LEVEL divided
by the strata (Bonferroni). Blocks are dealt to the rules in turn.
A rule's blocks go along a chain: its own grid from the mildest to the strictest step, then those of the rules
after it, round to the one before; a document's place is that of the first step that rejects it. The chain passes
up to its documents' first places, as many as it has blocks, and a rule takes the strictest step any chain passed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import Scratch, batch_of, slices

RISK, LEVEL = 0.02, 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects where the statistic is above its cutoff; steps are the candidate cutoffs, mildest first."""

    name: str
    steps: tuple[float, ...]


#: Fixed grids, mildest first. short_text is -n_words, so that every rule rejects above its cutoff.
RULES = (
    Rule("symbol_ratio", tuple(i / 200 for i in range(100, 0, -1))),
    Rule("duplicate_lines", tuple(i / 100 for i in range(95, 4, -1))),
    Rule("repeated_words", tuple(i / 100 for i in range(95, 4, -1))),
    Rule("long_words", tuple(i / 2 for i in range(60, 9, -1))),
    Rule("short_text", tuple(-float(i) for i in range(10, 61))),
)
_WHITE = b" \t\n\r\x0b\f"
_NOT_CHAR = _WHITE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def repeated_words(docs: list[list[bytes]]) -> np.ndarray:
    """For each text, the words within WINDOW-word windows that it has twice or more."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.fromiter((known.setdefault(w, len(known)) for d in docs for w in d), np.int64, int(sizes.sum()))
    out = np.zeros(len(docs), np.int64)
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return out
    doc = np.repeat(np.arange(len(docs)), sizes)
    h = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(WINDOW):
        h = (h ^ ids[j : n + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    at = at[np.argsort(h[at], kind="stable")]
    a, b = at[:-1], at[1:]
    same = (h[a] == h[b]) & (doc[a] == doc[b])
    a, b = a[same], b[same]
    equal = np.ones(len(a), bool)
    for j in range(WINDOW):
        equal &= ids[a + j] == ids[b + j]
    cover = np.zeros(len(ids) + 1, np.int64)
    found = np.unique(np.concatenate([a[equal], b[equal]]))
    cover[found] += 1
    np.add.at(cover, found + WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[inside], minlength=len(docs))


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    return len(lines), len(lines) - len(set(lines))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines; a narrow map of whole texts."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    out = rows.select(*keep).schema
    for name in names:
        out = out.add(name, "long")

    def run(batches):
        for batch, texts in slices(batches, "__text"):
            words = [t.split() for t in texts]
            lines = [duplicate_lines(t) for t in texts]
            own = [batch.column(n) for n in keep]
            fields = [pa.field(n, c.type) for n, c in zip(keep, own, strict=True)] + [pa.field(n, pa.int64()) for n in names]
            yield batch_of(
                pa.schema(fields),
                *own,
                [len(w) for w in words],
                [len(t.translate(None, _NOT_CHAR)) for t in texts],
                [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts],
                [d for _, d in lines],
                pa.array(repeated_words(words), pa.int64()),
                [n for n, _ in lines],
            )

    return rows.mapInArrow(run, out)


def rule_values() -> dict:
    """Columns of the rules' statistics; 0 for texts without words."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "duplicate_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "long_words": ratio("word_chars", "n_words"),
        "short_text": -F.col("n_words").cast("double"),
    }


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of probability p, by the incomplete beta function."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, p) / b


def blocks_within(n: int, risk: float, level: float) -> int:
    """The most blocks of n documents whose share exceeds risk with a probability of at most level.

    The share of k blocks, Beta(k, n - k + 1), exceeds risk just if fewer than k of n documents fall within risk.
    """
    low, high = 0, n
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if binomial_at_most(k - 1, n, risk) <= level else (low, k - 1)
    return low


def choose_cutoffs(values: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", good: str = "quality", rules: tuple[Rule, ...] = RULES, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """A row for each stratum with labelled good documents: stratum, holdout size and a cutoff (or null) for each rule.

    values has key, stratum and a column for each rule. All labelled rows count: each becomes, for each rule's
    chain, its place on it, and only counts by stratum, chain and place are shuffled further.
    """
    marked = values.join(labels.where(F.col(good) == 1).select(F.col(key).alias("__key")), F.col(key) == F.col("__key"))
    exceeded = lambda r: F.size(F.filter(F.lit(list(r.steps)), lambda s: F.col(r.name) > s))
    over = marked.select(F.col(stratum).alias("stratum"), *[exceeded(r).alias(r.name) for r in rules])
    sizes, n = [len(r.steps) for r in rules], len(rules)
    end = sum(sizes)
    # where each rule's grid starts on each chain
    offset = [{(c + j) % n: sum(sizes[(c + i) % n] for i in range(j)) for j in range(n)} for c in range(n)]
    # a value exceeds the last `over` steps of a grid that falls, so step size - over is the first it exceeds
    place = lambda c: F.array_min(F.array(*[F.when(F.col(r.name) > 0, F.lit(offset[c][i] + sizes[i]) - F.col(r.name)).otherwise(end) for i, r in enumerate(rules)]))
    each = over.select("stratum", F.posexplode(F.array(*map(place, range(n)))).alias("chain", "place"))
    counts = each.groupBy("stratum", "chain", "place").agg(F.count("*").alias("n"))
    strata = max(1, counts.select("stratum").distinct().count())
    names = [r.name for r in rules]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": pdf["stratum"].iloc[0], "n_good": int(pdf.loc[pdf["chain"] == 0, "n"].sum())}
        blocks, passed = blocks_within(row["n_good"], risk, level / strata), [0] * n
        for c in range(n):
            if share := blocks // n + (c < blocks % n):
                own = pdf[pdf["chain"] == c].sort_values("place")
                upto = int(own["place"].iloc[int((own["n"].cumsum() < share).sum())])
                passed = [max(k, min(sizes[i], upto - offset[c][i])) for i, k in enumerate(passed)]
        for rule, k in zip(rules, passed, strict=True):
            row[rule.name] = rule.steps[k - 1] if k else None
        return pd.DataFrame([row], columns=["stratum", "n_good", *names])

    schema = "stratum string, n_good long, " + ", ".join(f"{n} double" for n in names)
    return counts.groupBy("stratum").applyInPandas(settle, schema)


def quality_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", rules: tuple[Rule, ...] = RULES, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed, kept and rejected_by.

    base_failed: under 10 words, or over a fifth of the words in repeated windows; such documents are never
    kept. Others are kept unless a rule's statistic is above its stratum's cutoff; a stratum without enough
    labels for one block has no cutoffs and keeps them. Null and empty texts have no words and fail the base. A null stratum
    is one of its own; null keys match no label; repeated keys each get their own row, and a label on a
    repeated key counts for each. Empty tables give an empty result, no labels no cutoffs. Other columns are
    not read.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(stratum).cast("string").alias("__stratum"), F.col(text).alias("__text"))
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(statistics(base, ["doc_id", "__stratum"], "__text"), "statistics").withColumns(rule_values())
    cutoffs = choose_cutoffs(stats, labels.select(F.col(key).alias("doc_id"), "quality"), "doc_id", "__stratum", "quality", rules, risk, level)
    cuts = cutoffs.select("stratum", F.struct(*[r.name for r in rules]).alias("cut"))
    judged = stats.join(cuts, F.col("__stratum").eqNullSafe(F.col("stratum")), "left")
    hits = [F.when(F.col(r.name) > F.col(f"cut.{r.name}"), r.name) for r in rules]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rejected = F.when(failed, "base").otherwise(F.coalesce(*hits))
    return scratch.last(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), rejected.isNull().alias("kept"), rejected.alias("rejected_by")))
