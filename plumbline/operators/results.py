"""Verdicts, their aggregation, votes and spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import CITATION, CONTRADICTED, ERROR, GENERAL, GROUNDED, INVARIANT_ERROR, NOT_GROUNDED, OPEN, PARSE_ERROR, PARTIALLY_GROUNDED, SKIPPED, UNVERIFIABLE, VERIFIED, Profile

# Texts of results.
LEXICAL_VERDICT = "The source material fully supports the claim via high-confidence lexical retrieval."
LEXICAL_RATIONALE = "High-confidence BM25 match found in source material. LLM evaluation skipped for cost efficiency."
NUMERIC_VERDICT = "Numerical conflict detected in source."
NUMERIC_RATIONALE = "Claim number conflicts with source: "
FAILED_VERDICTS = {
    PARSE_ERROR: "Verification failed — LLM returned unparseable output after retry.",
    SKIPPED: "Verification skipped — batch spend cap exceeded.",
    INVARIANT_ERROR: "Verification failed — internal integrity violation.",
    ERROR: "Verification failed.",
    OPEN: "An evaluator is needed.",
}
INVARIANT = "citation must be non-null for VERIFIED results"
ATOM = f"struct<claim_text:string,claim_type:string,status:string,source_id:string,source_excerpt:string,reasoning_basis:array<string>,page_hint:string,verification_method:string,citation:{CITATION},unverifiable_reason:string>"
RESULT = (
    f"claim_id string, corpus_id string, is_valid boolean, overall_verdict string, verification_method string, atomic_claims array<{ATOM}>,"
    " factual_consistency_score double, sources_used array<string>, rationale string, offending_claim string, status string, cost_usd double"
)


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def atom(**fields: Column) -> Column:
    """An atomic claim's struct; what is not given is null."""
    names = [("claim_text", "string"), ("claim_type", "string"), ("status", "string"), ("source_id", "string"), ("source_excerpt", "string"), ("reasoning_basis", "array<string>"), ("page_hint", "string"), ("verification_method", "string"), ("citation", CITATION), ("unverifiable_reason", "string")]
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def citation(source_id: Column, excerpt: Column, start: Column | None = None, end: Column | None = None, confidence: Column | None = None, page_hint: Column | None = None) -> Column:
    parts = [("source_id", source_id, "string"), ("excerpt", excerpt, "string"), ("excerpt_char_start", start, "int"), ("excerpt_char_end", end, "int"), ("citation_confidence", confidence, "double"), ("page_hint", page_hint, "string")]
    return F.struct(*[(F.lit(None) if c is None else c).cast(t).alias(n) for n, c, t in parts])


def result(df: DataFrame, **columns: Column) -> DataFrame:
    """df's rows as results; missing columns are null, costs 0."""
    fields = [f.strip().split(" ", 1) for f in _fields(RESULT)]
    given = {"claim_id": F.col("claim_id"), "corpus_id": F.col("corpus_id"), "cost_usd": F.lit(0.0)} | columns
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]


def numeric_results(checked: DataFrame, claims: DataFrame, first_sources: DataFrame) -> DataFrame:
    """CONTRADICTED at no cost for claims whose numbers conflict; without a citation the first source is named."""
    df = checked.where("has_conflict").join(claims.select("claim_id", "corpus_id", "claim", "atoms"), ["claim_id", "corpus_id"]).join(first_sources, "corpus_id", "left")
    cited = F.when(F.col("citation").isNotNull(), citation(F.col("citation.source_id"), F.col("citation.excerpt"), F.col("citation.excerpt_char_start"), F.col("citation.excerpt_char_end")))
    verdict = F.lit(NUMERIC_VERDICT)
    why = F.concat(F.lit(NUMERIC_RATIONALE), F.coalesce("citation.excerpt", F.lit("None")))
    one = atom(claim_text=F.col("claim"), claim_type=F.coalesce(F.get("atoms", F.lit(0))["claim_type"], F.lit("Extractive")), status=F.lit(CONTRADICTED), source_id=F.coalesce("citation.source_id", "first_source"), source_excerpt=F.col("citation.excerpt"), verification_method=F.lit("tier25_numerical"), citation=cited)
    used = F.when(F.col("citation").isNotNull(), F.array("citation.source_id")).otherwise(F.array().cast("array<string>"))
    return result(df, is_valid=F.lit(False), overall_verdict=verdict, verification_method=F.lit("tier25_numerical"), atomic_claims=F.array(one), factual_consistency_score=F.lit(0.0), sources_used=used, rationale=why, offending_claim=F.col("claim"), status=F.lit(CONTRADICTED))


def lexical_results(claims: DataFrame, looked_at: DataFrame, chunks: DataFrame) -> DataFrame:
    """VERIFIED at no cost; the best chunk is the citation. claims: those that pass; looked_at: their chunks with ord."""
    mine = looked_at.join(claims.select("claim_id", "corpus_id"), ["claim_id", "corpus_id"], "left_semi")
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_id"))), lambda x: x["source_id"]))
    used = mine.groupBy("claim_id", "corpus_id").agg(listed.alias("used"), F.min_by(F.struct("source_ord", "chunk_ord"), "ord").alias("best"))
    text = chunks.select("corpus_id", F.struct("source_ord", "chunk_ord").alias("best"), "source_id", "text_content", "char_start", "char_end")
    df = claims.join(used, ["claim_id", "corpus_id"]).join(text, ["corpus_id", "best"], "left")
    cited = citation(F.col("source_id"), F.col("text_content"), F.col("char_start"), F.col("char_end"), F.lit(1.0))
    one = atom(claim_text=F.col("claim"), claim_type=F.coalesce(F.get("atoms", F.lit(0))["claim_type"], F.lit("Extractive")), status=F.lit(VERIFIED), source_id=F.get("used", F.lit(0)), citation=cited)
    return result(df, is_valid=F.lit(True), overall_verdict=F.lit(LEXICAL_VERDICT), verification_method=F.lit("tier2_lexical"), atomic_claims=F.array(one), factual_consistency_score=F.lit(1.0), sources_used=F.col("used"), rationale=F.lit(LEXICAL_RATIONALE), status=F.lit(VERIFIED))


def model_results(answers: DataFrame) -> DataFrame:
    """Results from valid responses.

    answers: claim_id, corpus_id, atoms, response (parsed), method, source_ids and page_hints (map) of the corpus,
    bundle_ids (sources of the evidence bundle), cost_usd. A verified extractive atom without an excerpt is
    unverifiable, and then so is a verified claim; sources that the corpus does not have are struck out.
    """
    r = F.col("response")
    said = F.when(r["textual_entailment"]["label"] == "Entailment", VERIFIED).when(r["textual_entailment"]["label"] == "Contradiction", CONTRADICTED).otherwise(UNVERIFIABLE)
    kind_of = lambda v: F.coalesce(F.get(F.filter(F.reverse("atoms"), lambda a: a["claim_text"] == v["claim_text"]), F.lit(0))["claim_type"], F.lit("Extractive"))

    def one(v: Column) -> Column:
        kind = kind_of(v)
        lost = (v["status"] == VERIFIED) & v["source_excerpt"].isNull() & (kind != "Inferential")
        status = F.when(lost, UNVERIFIABLE).otherwise(v["status"])
        hint = F.when(v["source_id"].isNotNull(), F.try_element_at("page_hints", v["source_id"]))
        sure = F.when(F.array_contains("bundle_ids", v["source_id"]), 0.0)
        cited = F.when((v["source_id"] != "") & (v["source_excerpt"] != "") & (status == VERIFIED), citation(v["source_id"], v["source_excerpt"], confidence=sure, page_hint=hint))
        why = F.when(status == UNVERIFIABLE, F.when(v["status"] == VERIFIED, "no_citation").otherwise("no_evidence"))
        return atom(claim_text=v["claim_text"], claim_type=kind, status=status, source_id=v["source_id"], source_excerpt=v["source_excerpt"], reasoning_basis=v["reasoning_basis"], page_hint=hint, verification_method=F.col("method"), citation=cited, unverifiable_reason=why)

    df = answers.withColumn("made", F.transform(r["verifications"], one))
    lost = (said == VERIFIED) & F.exists("made", lambda a: F.coalesce(a["unverifiable_reason"] == "no_citation", F.lit(False)))
    status = F.when(lost, UNVERIFIABLE).otherwise(said)
    kept = F.filter(r["source_attributions"], lambda a: (a["role"] != "Not Used") & F.array_contains("source_ids", a["source_id"]))
    offending = F.get(F.filter("made", lambda a: a["status"] == CONTRADICTED), F.lit(0))["claim_text"]
    return result(
        df,
        is_valid=status == VERIFIED,
        overall_verdict=r["overall_verdict"],
        verification_method=F.col("method"),
        atomic_claims=F.col("made"),
        factual_consistency_score=F.when(lost, 0.0).otherwise(r["factual_consistency_score"] / 100),
        sources_used=F.transform(kept, lambda a: a["source_id"]),
        rationale=r["overall_verdict"],
        offending_claim=offending,
        status=status,
        cost_usd=F.col("cost_usd"),
    )


def failed_results(rows: DataFrame, status: str, message: Column, cost: Column | None = None) -> DataFrame:
    """Rows that could not be settled, each with its reason, so that one failure is no other claim's."""
    none = F.array().cast(f"array<{ATOM}>")
    verdict = F.lit(FAILED_VERDICTS[status])
    return result(rows, is_valid=F.lit(False), overall_verdict=verdict, verification_method=F.lit("skipped"), atomic_claims=none, factual_consistency_score=F.lit(0.0), sources_used=F.array().cast("array<string>"), rationale=message, status=F.lit(status), cost_usd=F.lit(0.0) if cost is None else cost)


def citation_invariant(results: DataFrame) -> DataFrame:
    """results in which a verified one has a citation for each verified atom; others become INVARIANT_ERROR rows that keep their cost."""
    bare = F.exists("atomic_claims", lambda a: (a["status"] == VERIFIED) & a["citation"].isNull())
    broken = (F.col("status") == VERIFIED) & (F.coalesce(bare, F.lit(False)) | (F.coalesce(F.size("atomic_claims"), F.lit(0)) <= 0))
    failed = failed_results(results.where(broken), INVARIANT_ERROR, F.lit(INVARIANT), F.col("cost_usd"))
    return results.where(~F.coalesce(broken, F.lit(False))).unionByName(failed)


def spend_capped(costs: DataFrame, max_spend: float, order: str = "input_ord", cost: str = "cost_usd", group: str | None = None, stages=None) -> DataFrame:
    """spent, the cost so far in input order, and skipped where that exceeds max_spend.

    One budget is one running sum; give group for one budget each. With stages a single budget is summed in parts:
    rows are dealt by ranges of order and written, the parts' sums run on from part to part, and within a part each
    task runs its own.
    """
    if group is None and stages is not None:
        dealt = costs.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
        dealt = stages.keep(dealt, "spend")
        parts = dealt.groupBy("__part").agg(F.sum(cost).alias("__sum"))
        before = parts.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__before"))
        inside = F.sum(cost).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        spent = dealt.withColumn("__inside", inside).join(before, "__part").withColumn("spent", F.col("__before") + F.col("__inside"))
        return spent.withColumn("skipped", F.col("spent") > max_spend).drop("__part", "__inside", "__before")
    w = Window.partitionBy(*([group] if group else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(cost).over(w)
    return costs.withColumn("spent", spent).withColumn("skipped", F.col("spent") > max_spend)


def analysis_summary(results: DataFrame, key: str = "analysis_id", profile: Profile = GENERAL) -> DataFrame:
    """Per analysis: score = verified / (verified + contradicted + errors), status, counts."""
    one = lambda s: F.count_if(F.col("status") == s)
    df = results.groupBy(key).agg(F.count("*").alias("total_units"), one(VERIFIED).alias("grounded_units"), one(CONTRADICTED).alias("ungrounded_units"), one(UNVERIFIABLE).alias("unverifiable_units"))
    scored = F.col("total_units") - F.col("unverifiable_units")
    df = df.withColumn("score", F.when(scored > 0, F.col("grounded_units") / scored).otherwise(0.0))
    status = F.when(scored == 0, NOT_GROUNDED).when(F.col("score") >= profile.faithfulness_threshold, GROUNDED).when(F.col("score") > 0, PARTIALLY_GROUNDED).otherwise(NOT_GROUNDED)
    df = df.withColumn("status", status)
    # units of all-unverifiable analyses are only counted as such
    return df.withColumns({"is_grounded": F.col("status") == GROUNDED, "evaluation_method": F.lit("claim_extraction")})


def faithfulness_summary(verdicts: DataFrame, key: str = "answer_id", threshold: float = GENERAL.faithfulness_threshold) -> DataFrame:
    """Per answer from its sentences' verdicts: score = entailed / all, status, is_grounded.

    An answer without a sentence (one null verdict) counts as one that is not entailed: partially grounded at 0.
    """
    df = verdicts.groupBy(key).agg(F.count("verdict").alias("total"), F.count_if(F.col("verdict") == "Entailment").alias("entailed"), F.count_if(F.col("verdict") == "Contradiction").alias("contradicted"))
    score = F.col("entailed") / F.greatest("total", F.lit(1))
    status = F.when(F.col("contradicted") > 0, NOT_GROUNDED).when(F.col("entailed") == F.greatest("total", F.lit(1)), GROUNDED).otherwise(PARTIALLY_GROUNDED)
    df = df.withColumns({"score": score, "status": status})
    return df.withColumn("is_grounded", (F.col("status") != NOT_GROUNDED) & (F.col("score") >= threshold))


def majority(votes: DataFrame, key: str = "answer_id", threshold: float = GENERAL.faithfulness_threshold) -> DataFrame:
    """Of evaluations (key, vote, status, score) the status most have; all different: not grounded, lowest score.

    Each vote counts as not grounded, or grounded if its score reaches the threshold, or partially grounded. The
    score is the first winning vote's.
    """
    cast = F.when(F.col("status") == NOT_GROUNDED, NOT_GROUNDED).when(F.col("score") >= threshold, GROUNDED).otherwise(PARTIALLY_GROUNDED)
    by = votes.withColumn("cast", cast).groupBy(key, "cast").agg(F.count("*").alias("n"), F.min_by("score", "vote").alias("first_score"), F.min("vote").alias("first_vote"), F.min("score").alias("least"))
    best = by.groupBy(key).agg(F.min_by(F.struct("cast", "first_score", "n"), F.struct(-F.col("n"), "first_vote")).alias("won"), F.min("least").alias("least"), F.sum("n").alias("votes"))
    tie = (F.col("won.n") == 1) & (F.col("votes") > 1)
    df = best.select(key, F.when(tie, NOT_GROUNDED).otherwise(F.col("won.cast")).alias("status"), F.when(tie, F.col("least")).otherwise(F.col("won.first_score")).alias("score"), tie.alias("tie_broken"))
    return df.withColumn("is_grounded", (F.col("status") != NOT_GROUNDED) & (F.col("score") >= threshold))


def accumulated(results: DataFrame, key: str) -> DataFrame:
    """Per conversation: overall_score from unit counts, else the mean score; is_grounded if all are."""
    grounded, units = F.sum("grounded_units"), F.sum(F.col("grounded_units") + F.col("ungrounded_units"))
    score = F.when(units > 0, grounded / units).otherwise(F.avg("score"))
    return results.groupBy(key).agg(score.alias("overall_score"), F.bool_and("is_grounded").alias("is_grounded"), F.count("*").alias("n_results"))


def benchmark_metrics(results: DataFrame) -> DataFrame:
    """Per sample: counts of statuses, the share of unverifiable units and whether one contradicts."""
    one = lambda s: F.count_if(F.col("status") == s)
    df = results.groupBy("sample_id").agg(F.count("*").alias("n_units"), one(VERIFIED).alias("verified_count"), one(CONTRADICTED).alias("contradicted_count"), one(UNVERIFIABLE).alias("unverifiable_count"))
    return df.withColumns({"has_contradiction": F.col("contradicted_count") > 0, "unverifiable_ratio": F.col("unverifiable_count") / F.col("n_units")})


def unprocessed(samples: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples without a stored result."""
    return samples.join(done.select(key).distinct(), key, "left_anti")
