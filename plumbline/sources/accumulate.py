"""Sources gathered over several steps, and the text around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import strip


def first_of_each(sources: DataFrame, key: list[str], order: list[str], llm_steps: list[int] | None = None, step: str = "step") -> DataFrame:
    """The first source of each key in the given order; those of llm_steps are marked as a model's.

    A minimum that combines before the shuffle, not a sort of each key's rows.
    """
    rest = [c for c in sources.columns if c not in key]
    first = sources.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])
    return first.withColumn("derived_from_llm", F.col(step).isin(*llm_steps) if llm_steps else F.lit(False))


def with_boundary_context(sources: DataFrame, group: str, order: str, content: str = "content", name: str | None = None) -> DataFrame:
    """prev_context, the last sentence before each source, and next_context, the first one after it, within each group.

    With name, a column of ids, neighbours give context only if their ids agree before the first `::`.
    """
    w = Window.partitionBy(group).orderBy(order)
    before, after = F.lag(content).over(w), F.lead(content).over(w)
    if name:
        own = F.substring_index(name, "::", 1)
        before = F.when(F.lag(own).over(w).eqNullSafe(own), before)
        after = F.when(F.lead(own).over(w).eqNullSafe(own), after)
    parts = F.filter(F.transform(F.split(before, r"\."), strip), lambda p: p != "")
    last = F.when(F.size(parts) > 0, F.concat(F.element_at(parts, -1), F.lit("."))).otherwise(before)
    first = F.when(F.instr(after, ".") > 0, F.concat(F.substring_index(after, ".", 1), F.lit("."))).otherwise(after)
    return sources.withColumns({"prev_context": F.when(before.isNotNull(), last), "next_context": F.when(after.isNotNull(), first)})


def terms(sources: DataFrame) -> DataFrame:
    """term (lower case) and the last definition that says what it means."""
    term = F.lower(F.regexp_extract("content", r'"([^"]+)"\s+means\s+', 1))
    told = sources.where(F.col("source_type") == "legal_definition").withColumn("term", term).where("term <> ''")
    return told.groupBy("corpus_id", "term").agg(F.max_by(F.struct("source_ord", "source_id", "content"), "source_ord").alias("x")).select("corpus_id", "term", "x.*")


def has_model_text(sources: DataFrame) -> DataFrame:
    """Per corpus its number of sources and whether one comes from a model."""
    return sources.groupBy("corpus_id").agg(F.count("*").alias("n_sources"), F.bool_or("derived_from_llm").alias("has_llm_derived"))
