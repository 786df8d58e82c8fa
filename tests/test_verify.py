"""Whole plans with scripted and offline evaluators, summaries, breakers and streams."""

import json
from dataclasses import dataclass
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from plumbline.evaluators.protocol import Overlap, Scripted, salvaged
from plumbline.model import CITATION, GENERAL, STRICT, Config, GroundingError, HallucinatedEvidenceError, InvariantError
from plumbline.operators import results
from plumbline.operators.fuzzy import indel_ratio, partial_ratio
from plumbline.plans import stages
from plumbline.plans.stages import _LEFT, Stages, trim
from plumbline.plans.verify import assert_faithful, assert_grounded, audited, logged, raise_failure, verify, verify_analysis, verify_answer, verify_clause, verify_or_retry, verify_structured
from plumbline.sources.accumulate import terms, with_boundary_context
from plumbline.sources.tables import document_texts, docx_paragraphs, paragraph_sources, sections, xlsx_rows
from plumbline.streaming.verify import conversation_scores, verify_stream

FACTS = ["The Q3 revenue was $5 million.", "Paris hosts the office.", "Staff enjoy lunch.", "Rain fell on Monday.", "The roof is green."]


def response(label="Entailment", status="VERIFIED", excerpt="words", **more):
    return json.dumps({
        "textual_entailment": {"label": label, "probability": 0.9},
        "conceptual_coverage": {"percentage": 100, "covered_concepts": [], "missing_concepts": []},
        "factual_consistency_score": 80,
        "verifications": [{"claim_text": "x", "status": status, "source_id": "s0", "source_excerpt": excerpt, "reasoning_basis": None}],
        "source_attributions": [{"source_id": "s0", "role": "Supporting"}, {"source_id": "made-up", "role": "Supporting"}, {"source_id": "s1", "role": "Not Used"}],
        "overall_verdict": "v",
    } | more)


def corpus(spark, texts=FACTS, name="c"):
    return spark.createDataFrame([(name, i, f"s{i}", t) for i, t in enumerate(texts)], "corpus_id string, source_ord long, source_id string, content string")


def claim(spark, *texts, corpus_id="c"):
    return spark.createDataFrame([(str(i), corpus_id, t, i) for i, t in enumerate(texts)], "claim_id string, corpus_id string, claim string, input_ord long")


def settled(df):
    return {r.claim_id: r for r in df.collect()}


def test_lexical_pass(spark):
    r = settled(verify(claim(spark, "The Q3 revenue was $5 million."), corpus(spark)))["0"]
    assert (r.status, r.verification_method, r.cost_usd) == ("VERIFIED", "tier2_lexical", 0)
    assert r.atomic_claims[0].citation.source_id == "s0" and r.sources_used[0] == "s0"


def test_numeric_exit(spark):
    r = settled(verify(claim(spark, "The Q3 revenue was $7 million."), corpus(spark)))["0"]
    assert (r.status, r.verification_method, r.offending_claim) == ("CONTRADICTED", "tier25_numerical", "The Q3 revenue was $7 million.")


def test_model_result_and_scrubbed_sources(spark):
    r = settled(verify(claim(spark, "Unrelated words entirely"), corpus(spark), evaluator=Scripted(default=response())))["0"]
    assert (r.status, r.is_valid, r.factual_consistency_score, r.sources_used) == ("VERIFIED", True, 0.8, ["s0"])


def test_verified_without_excerpt_is_downgraded(spark):
    said = response(excerpt=None).replace('"reasoning_basis": null', '"reasoning_basis": ["a"]')
    r = settled(verify(claim(spark, "Unrelated words entirely"), corpus(spark), evaluator=Scripted(default=said)))["0"]
    assert (r.status, r.factual_consistency_score, r.atomic_claims[0].unverifiable_reason) == ("UNVERIFIABLE", 0.0, "no_citation")


def test_contradiction_beats_score(spark):
    r = settled(verify(claim(spark, "Unrelated words entirely"), corpus(spark), evaluator=Scripted(default=response("Contradiction", "CONTRADICTED"))))["0"]
    assert (r.status, r.is_valid, r.offending_claim) == ("CONTRADICTED", False, "x")


def test_failures_stay_apart(spark):
    claims = claim(spark, "Unrelated words entirely", "", "The Q3 revenue was $5 million.").unionByName(claim(spark, "No sources for this", corpus_id="none").withColumn("claim_id", F.lit("9")))
    r = settled(verify(claims, corpus(spark), evaluator=Scripted(default="no JSON", cost=0.01)))
    assert [r[k].status for k in "0129"] == ["PARSE_ERROR", "ERROR", "VERIFIED", "ERROR"]
    assert r["0"].cost_usd == pytest.approx(0.02)  # two attempts


def test_evidence(spark):
    claims = claim(spark, "Unrelated words entirely", "Unrelated words again").withColumn("evidence", F.when(F.col("claim_id") == "0", "zzz qqq").otherwise("green"))
    r = settled(verify(claims, corpus(spark), evaluator=Scripted(default=response())))
    assert (r["0"].status, r["1"].status) == ("ERROR", "VERIFIED")


def test_spend_cap(spark):
    texts = [f"Unrelated words {w}" for w in ("one", "two", "three")]
    r = settled(verify(claim(spark, *texts), corpus(spark), Config(max_spend=0.25), Scripted(default=response(), cost=0.1)))
    assert [r[k].status for k in "012"] == ["VERIFIED", "VERIFIED", "SKIPPED_DUE_TO_COST"]
    assert [r[k].cost_usd for k in "012"] == pytest.approx([0.1, 0.2, 0.0])


@dataclass(frozen=True)
class Counting:
    """Notes every prompt in a file."""

    path: str

    def complete(self, prompts):
        with open(self.path, "a") as f:
            f.write("x" * len(prompts))
        return [(response(), 0.0) for _ in prompts]


def test_cached_responses_are_not_asked_again(spark, tmp_path):
    for _ in range(2):
        verify(claim(spark, "Unrelated words entirely"), corpus(spark), evaluator=Counting(f"{tmp_path}/n"), cache=f"file://{tmp_path}/cache").collect()
    assert (tmp_path / "n").read_text() == "x"


def test_answer(spark):
    df = spark.createDataFrame([("a", "c", "Rain fell on Monday. The roof is red and tall and wide.")], "answer_id string, corpus_id string, answer string")
    r = verify_answer(df, corpus(spark), Overlap()).head()
    assert (r.status, r.score, r.is_grounded) == ("PARTIALLY_GROUNDED", 0.5, False)
    r = verify_answer(df, corpus(spark), Overlap(), Config(profile=STRICT)).head()
    assert (r.status, r.tie_broken) == ("PARTIALLY_GROUNDED", False)
    assert verify_answer(df, corpus(spark), Scripted(default="?")).head().status == "ERROR"


def test_analysis(spark):
    df = spark.createDataFrame([("a", "c", "Rain fell on Monday. The Q3 revenue was $7 million."), ("b", "c", "x")], "analysis_id string, corpus_id string, text string")
    r = {x.analysis_id: x for x in verify_analysis(df, corpus(spark), Overlap()).collect()}
    assert (r["a"].grounded_units, r["a"].ungrounded_units, r["a"].score) == (1, 1, 0.5)
    failed = verify_analysis(df, corpus(spark), Scripted(default="?")).collect()
    assert {x.status for x in failed} == {"ERROR"} and len(failed) == 2


def test_clause_gets_its_terms(spark):
    defs = spark.createDataFrame([("c", 0, "d0", '"Total Fee" means the sum of all.', "legal_definition")], "corpus_id string, source_ord long, source_id string, content string, source_type string")
    clauses = spark.createDataFrame([("1", "c", "The Total Fee shall not be exceeded by the buyer.")], "clause_id string, corpus_id string, clause string")
    r = verify_clause(clauses, corpus(spark), terms(defs), evaluator=Overlap(share=0.1)).head()
    assert r.status in ("VERIFIED", "UNVERIFIABLE") and r.claim_id == "1"


def test_clauses_with_the_same_terms_share_their_sources(spark, monkeypatch):
    defs = spark.createDataFrame([("c", 0, "d0", '"Total Fee" means the sum of all.', "legal_definition")], "corpus_id string, source_ord long, source_id string, content string, source_type string")
    texts = [f"Buyer {i} shall pay the Total Fee." for i in range(6)] + ["Rain fell on Monday."]
    clauses = spark.createDataFrame([(str(i), "c", t) for i, t in enumerate(texts)], "clause_id string, corpus_id string, clause string")
    given = []

    def seen(claims, sources, *how):
        given.append(sources.count())
        return verify(claims, sources, *how)

    monkeypatch.setattr("plumbline.plans.verify.verify", seen)
    rows = verify_clause(clauses, corpus(spark), terms(defs), evaluator=Overlap(share=0.1)).collect()
    assert {(r.claim_id, r.corpus_id) for r in rows} == {(str(i), f"c|{i}") for i in range(7)}
    assert given == [2 * len(FACTS) + 1]


def test_written_stages_relieve_a_grown_heap():
    class Runtime:
        def __init__(self, total):
            self.totalMemory, self.maxMemory = lambda: total, lambda: 100

    for total, times in ((80, 1), (30, 0)):
        done = []
        jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda t=total: Runtime(t)))), System=SimpleNamespace(gc=lambda d=done: d.append(1)))
        rows = SimpleNamespace(write=SimpleNamespace(parquet=lambda path: None), schema=None)
        reader = SimpleNamespace(schema=lambda s: SimpleNamespace(parquet=lambda path: path))
        Stages(SimpleNamespace(_jvm=jvm, conf={"spark.checkpoint.dir": "file:///none"}, read=reader), "p").keep(rows, "t")
        assert len(done) == times
        _LEFT.pop()


def test_written_stages_give_native_memory_back(spark, monkeypatch):
    assert trim(spark)
    done = []
    monkeypatch.setattr(stages, "trim", lambda s: done.append(s))
    Stages(spark, "t").keep(spark.range(3), "n")
    assert done == [spark]


def test_rows_of_one_file_use_all_cores(spark, monkeypatch):
    texts = [f"The {i} th word is green." for i in range(40)]
    parts, keep = {}, Stages.keep

    def seen(self, df, name):
        out = keep(self, df, name)
        parts[name] = out.select(F.input_file_name()).distinct().count()
        return out

    monkeypatch.setattr(Stages, "keep", seen)
    assert verify(claim(spark, *texts).coalesce(1), corpus(spark, texts).coalesce(1)).count() == 40
    assert parts["said"] > 4 and parts["chunks"] > 4


def test_structured(spark):
    df = spark.createDataFrame([("1", "c", '{"a": {"b": "5M"}}'), ("2", "c", "not json")], "claim_id string, corpus_id string, rec string")
    r = settled(verify_structured(df, "rec", corpus(spark, ["a.b: 5M"]), evaluator=Overlap(), schema="a struct<b:string>"))
    assert r["1"].status == "VERIFIED" and r["2"].status == "ERROR"
    df = spark.createDataFrame([("3", "c", '{"a": "no", "b": "x"}')], "claim_id string, corpus_id string, rec string")
    assert settled(verify_structured(df, "rec", corpus(spark, ["a: 1"]), evaluator=Overlap(), schema="a int, b string"))["3"].status == "ERROR"


def test_breakers(spark):
    assert_faithful(spark, "Rain fell on Monday.", FACTS, Overlap())
    assert_grounded(spark, "Rain fell on Monday.", FACTS, Overlap())
    with pytest.raises(GroundingError):
        assert_faithful(spark, "Snow lay everywhere else.", FACTS, Overlap())
    outputs = iter(["Snow lay everywhere else.", "Rain fell on Monday."])
    assert verify_or_retry(spark, lambda: next(outputs), FACTS, Overlap()) == "Rain fell on Monday."


def test_summaries(spark):
    rows = [("a", s) for s in ["VERIFIED"] * 4 + ["CONTRADICTED"]] + [("b", "UNVERIFIABLE")] * 5 + [("c", "ERROR"), ("c", "VERIFIED")]
    got = {r.analysis_id: r for r in results.analysis_summary(spark.createDataFrame(rows, "analysis_id string, status string")).collect()}
    assert (got["a"].status, got["a"].score) == ("GROUNDED", 0.8)
    assert (got["b"].status, got["b"].score, got["b"].unverifiable_units) == ("NOT_GROUNDED", 0.0, 5)
    assert (got["c"].status, got["c"].score) == ("PARTIALLY_GROUNDED", 0.5)


def test_votes(spark):
    rows = [("two", 0, "GROUNDED", 0.9), ("two", 1, "NOT_GROUNDED", 0.1), ("two", 2, "GROUNDED", 0.95), ("tie", 0, "GROUNDED", 0.9), ("tie", 1, "NOT_GROUNDED", 0.1), ("tie", 2, "PARTIALLY_GROUNDED", 0.5)]
    got = {r.answer_id: r for r in results.majority(spark.createDataFrame(rows, "answer_id string, vote int, status string, score double")).collect()}
    assert (got["two"].status, got["two"].score, got["two"].tie_broken) == ("GROUNDED", 0.9, False)
    assert (got["tie"].status, got["tie"].score, got["tie"].tie_broken) == ("NOT_GROUNDED", 0.1, True)


def test_accumulated(spark):
    rows = [("a", 1, 0, 0.1, True), ("b", 1, 1, 1.0, True), ("b", 1, 0, 1.0, False), ("c", 0, 0, 0.5, True), ("c", 0, 0, 1.0, True)]
    df = spark.createDataFrame(rows, "conv_id string, grounded_units int, ungrounded_units int, score double, is_grounded boolean")
    for f in (lambda d: results.accumulated(d, "conv_id"), conversation_scores):
        got = {r.conv_id: (round(r.overall_score, 6), r.is_grounded) for r in f(df).collect()}
        assert got == {"a": (1.0, True), "b": (round(2 / 3, 6), False), "c": (0.75, True)}


def test_stream(spark, tmp_path):
    claim(spark, "The Q3 revenue was $5 million.", "The Q3 revenue was $7 million.").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("claim_id string, corpus_id string, claim string, input_ord long").parquet(f"{tmp_path}/in")
    q = verify_stream(stream, corpus(spark), f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["CONTRADICTED", "VERIFIED"]


def test_empty_tables(spark):
    none = claim(spark, "x").where("false")
    assert verify(none, corpus(spark), evaluator=Overlap()).count() == 0
    assert settled(verify(claim(spark, "x"), corpus(spark).where("false"), evaluator=Overlap()))["0"].status == "ERROR"
    assert GENERAL.top_k == 6


def test_no_claim_is_left_out(spark):
    r = settled(verify(claim(spark, "Unrelated words entirely", "The Q3 revenue was $7 million.", ""), corpus(spark)))
    assert [(r[k].status, r[k].verification_method) for k in "012"] == [("OPEN", "skipped"), ("CONTRADICTED", "tier25_numerical"), ("ERROR", "skipped")]
    assert r["1"].overall_verdict == "Numerical conflict detected in source."


def test_citation_goes_on_to_the_number(spark):
    texts = ["Revenue was $7 million.", "Nothing else is told."]
    r = settled(verify(claim(spark, "In 2023 revenue was $5 million."), corpus(spark, texts)))["0"]
    assert r.status == "CONTRADICTED" and r.atomic_claims[0].citation.source_id == "s0" and "7" in r.atomic_claims[0].citation.excerpt


def test_no_analysis_is_left_out(spark):
    df = spark.createDataFrame([("a", "c", "Rain fell on Monday."), ("b", "c", ""), ("d", "none", "Rain fell on Monday."), ("e", "c", None)], "analysis_id string, corpus_id string, text string")
    r = {x.analysis_id: x for x in verify_analysis(df, corpus(spark), Overlap()).collect()}
    assert {k: (x.status, x.total_units, x.score) for k, x in r.items()} == {"a": ("GROUNDED", 1, 1.0), "b": ("NOT_GROUNDED", 0, 0.0), "d": ("NOT_GROUNDED", 1, 0.0), "e": ("NOT_GROUNDED", 0, 0.0)}


@dataclass(frozen=True)
class Second:
    """Lists claims only when it is asked again."""

    def complete(self, prompts):
        return [(json.dumps({"claims": ["Rain fell on Monday."]}) if "no list of claims" in p else "?", 0.0) if "TEXT-" in p else (response(), 0.0) for p in prompts]


def test_extraction_is_asked_twice(spark):
    df = spark.createDataFrame([("a", "c", "Rain.")], "analysis_id string, corpus_id string, text string")
    r = verify_analysis(df, corpus(spark), Second()).head()
    assert (r.status, r.total_units) == ("GROUNDED", 1)


def test_no_answer_is_left_out(spark):
    rows = [("a", "c", "Rain fell on Monday. It did."), ("b", "c", ""), ("d", "none", "Rain fell on Monday."), ("e", "c", None)]
    df = spark.createDataFrame(rows, "answer_id string, corpus_id string, answer string")
    r = {x.answer_id: x for x in verify_answer(df, corpus(spark), Overlap(cost=0.01)).collect()}
    assert {k: (x.status, x.score, x.total_units) for k, x in r.items()} == {"a": ("PARTIALLY_GROUNDED", 0.5, 2), "b": ("PARTIALLY_GROUNDED", 0.0, 0), "d": ("PARTIALLY_GROUNDED", 0.0, 1), "e": ("PARTIALLY_GROUNDED", 0.0, 0)}
    assert (r["a"].grounded_units, r["a"].ungrounded_units, r["a"].cost_usd, r["a"].evaluation_method) == (1, 0, 0.01, "sentence_entailment")
    assert [(u.enrichment_method, u.preceding_sentence, u.verdict) for u in r["a"].unit_results] == [("none", None, "Entailment"), ("llm_coreference", "Rain fell on Monday.", "Neutral")]


def test_audit_and_hints(spark):
    df = spark.createDataFrame([("a", "c", "Rain fell on Monday. The roof is red and tall and wide.")], "answer_id string, corpus_id string, answer string")
    one = verify_answer(df, corpus(spark), Overlap(), Config(profile=audited(GENERAL))).head()
    assert [(x.verdict, x.profile_name, x.majority_vote_triggered) for x in one.audit_records] == [("Entailment", "general", False), ("Neutral", "general", False)]
    three = verify_answer(df, corpus(spark), Overlap(), Config(profile=STRICT)).head()
    assert [x.verdict for x in three.audit_records] == ["PARTIALLY_GROUNDED"] * 3 and three.audit_records[0].claim_text.startswith("Rain")
    assert "audit_records" not in verify_answer(df, corpus(spark), Overlap()).columns
    hint = F.array(F.struct(F.lit("Rain").alias("display_text"), F.lit("Rain fell on Monday.").alias("claim_text"), F.lit("table").alias("enrichment_method")))
    told = verify_answer(df.withColumn("h", hint), corpus(spark), Overlap(), hints="h").head()
    assert (told.status, told.total_units, told.unit_results[0].display_text) == ("GROUNDED", 1, "Rain")


def test_spend_runs_over_all_parts(spark):
    rows = spark.range(2000).select(F.col("id").alias("input_ord"), ((F.col("id") % 7) / 8).alias("cost_usd")).repartition(5)
    got = {r.input_ord: (r.spent, r.skipped) for r in results.spend_capped(rows, 100.0, stages=Stages(spark, "t")).collect()}
    spent = 0.0
    for i in range(2000):
        spent += (i % 7) / 8
        assert got[i] == (spent, spent > 100.0)


@dataclass(frozen=True)
class Named:
    name: str = "default"

    def with_model(self, model):
        return Named(model)

    def complete(self, prompts):
        return [(response(overall_verdict=self.name), 0.0) for _ in prompts]


def test_claims_have_models_and_chunking_of_their_own(spark):
    claims = claim(spark, "Unrelated words entirely", "Unrelated words again").withColumns({"model": F.when(F.col("claim_id") == "1", "ollama/x"), "auto_chunk": F.when(F.col("claim_id") == "1", False)})
    r = settled(verify(claims, corpus(spark), evaluator=Named()))
    assert [r[k].overall_verdict for k in "01"] == ["default", "ollama/x"]


def test_invariant_and_failures(spark):
    good = verify(claim(spark, "The Q3 revenue was $5 million."), corpus(spark))
    bare = good.withColumn("atomic_claims", F.transform("atomic_claims", lambda a: a.withField("citation", F.lit(None).cast(CITATION))))
    assert results.citation_invariant(good).head().status == "VERIFIED"
    broken = results.citation_invariant(bare.withColumn("cost_usd", F.lit(0.5))).head()
    assert (broken.status, broken.cost_usd) == ("INVARIANT_ERROR", 0.5)
    with pytest.raises(InvariantError):
        raise_failure(broken)
    claims = claim(spark, "Unrelated words entirely").withColumn("evidence", F.lit("zzz qqq"))
    with pytest.raises(HallucinatedEvidenceError):
        raise_failure(verify(claims, corpus(spark)).head())
    raise_failure(good.head())


def test_exports_and_log(spark, caplog):
    import plumbline

    assert all(getattr(plumbline, name) is not None for name in plumbline.__all__) and len(plumbline.__all__) >= 28
    rows = logged(verify(claim(spark, "Unrelated words entirely"), corpus(spark)))
    assert rows.head().status == "OPEN"
    with caplog.at_level("INFO", logger="plumbline"):
        verify(claim(spark, "A secret claim"), corpus(spark))
    assert caplog.records and all("secret" not in r.getMessage() for r in caplog.records)


def test_salvaged():
    said = {"verifications": [{"claim_text": "x", "source_excerpt": "y"}]}
    message = "refused: " + json.dumps({"error": {"code": "json_validate_failed", "failed_generation": json.dumps(said)}})
    assert json.loads(salvaged(message)) == {"verifications": [{"claim_text": "x", "source_excerpt": "y", "reasoning_basis": None}]}
    assert salvaged("none") is None and salvaged('{"error": {"code": "other", "failed_generation": "{}"}}') is None


def test_boundary_context_by_names(spark):
    df = spark.createDataFrame([("c", 0, "a::1", "One. Two."), ("c", 1, "a::2", "Three. Four."), ("c", 2, "b::1", "Five.")], "corpus_id string, source_ord long, source_id string, content string")
    r = {x.source_id: x for x in with_boundary_context(df, "corpus_id", "source_ord", name="source_id").collect()}
    assert (r["a::1"].next_context, r["a::2"].prev_context, r["a::2"].next_context, r["b::1"].prev_context) == ("Three.", "Two.", None, None)


def test_disjoint_evidence_is_compared_exactly():
    import random

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abc d") for _ in range(n))
    for _ in range(300):
        a, b = text(rng.randint(0, 9)), text(rng.randint(0, 40))
        short, long_ = (a, b) if len(a) <= len(b) else (b, a)
        n, best = len(short), 0.0
        for end in range(1, len(long_) + n):
            lo, hi = max(0, end - n), min(end, len(long_))
            edge = long_[hi - 1] if hi < len(long_) or hi - lo == n else long_[lo]
            if edge in short:
                best = max(best, indel_ratio(short, long_[lo:hi]))
        assert partial_ratio(a, b) == (best if n else (100.0 if not long_ else 0.0))


def zipped(files):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("H1", "Scope") + "<w:p><w:r><w:t>All </w:t><w:t>goods.</w:t></w:r></w:p><w:p/>" + p("H1", "Price") + "<w:p><w:r><w:t>Five.</w:t></w:r></w:p>"
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles}))
    got = sections(docx_paragraphs(spark, f"file://{tmp_path}/a.docx")).orderBy("source_ord").collect()
    assert [(r.source_id, r.content) for r in got] == [("section_0", "Scope\nAll goods."), ("section_1", "Price\nFive.")]
    para = paragraph_sources(docx_paragraphs(spark, f"file://{tmp_path}/a.docx")).orderBy("source_ord").collect()
    assert [r.source_id for r in para] == ["para_0", "para_1", "para_3", "para_4"]
    assert document_texts(spark, f"file://{tmp_path}/a.docx", "docx").head().text == "Scope\nAll goods.\n\nPrice\nFive."
    m, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Open</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>4.5</v></c><c r="C2" t="b"><v>1</v></c></row><row r="4"><c r="B4"><v>7</v></c></row></sheetData></worksheet>'
    files = {
        "xl/workbook.xml": f'<workbook {m} {r}><sheets><sheet name="My list" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {m}><si><t>Name</t></si><si><t>Bolt</t></si></sst>",
        "xl/worksheets/sheet1.xml": sheet,
    }
    (tmp_path / "b.xlsx").write_bytes(zipped(files))
    got = xlsx_rows(spark, f"file://{tmp_path}/b.xlsx").orderBy("source_ord").collect()
    assert [(x.source_id, x.content) for x in got] == [("My_list_row_1", "Name: Bolt\ncol_1: 4.5\nOpen: True"), ("My_list_row_3", "col_1: 7")]
