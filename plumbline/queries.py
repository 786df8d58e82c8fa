"""Queries over the standard tables, one for each operator or group of operators. SQL equivalents are in oracle.py.

Rows of floating point are rounded to six places, sums being taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.evaluators import prompts, responses
from plumbline.evaluators.protocol import Overlap, adapter, response_text
from plumbline.functions import text as tx
from plumbline.functions.number_columns import masked_structural, normal_accounting, normal_european, years_in_context
from plumbline.functions.quantities import find_numbers, prepared
from plumbline.model import GENERAL, LEXICAL_PASS, Config
from plumbline.operators import clauses, costs, fuzzy, numeric, results, retrieval
from plumbline.operators.chunking import chunk_sources, whole_chunks
from plumbline.plans.verify import verify, verify_analysis, verify_answer, verify_clause, verify_structured
from plumbline.sources import accumulate, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_sources(spark: SparkSession, sf: str) -> DataFrame:
    """documents as sources, a corpus for each of their sources, in order of doc_id."""
    d = read(spark, sf, "documents")
    return d.select(F.col("source").alias("corpus_id"), F.col("doc_id").alias("source_ord"), F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"))


def bench_claims(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark items as claims, dealt over the twenty corpora."""
    b = read(spark, sf, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("claim_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("corpus_id"), F.col("text").alias("claim"), F.col("item_id").alias("input_ord"))


def part_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus of one sentence about each part's price."""
    p = read(spark, sf, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    content = F.concat(F.lit("The listed price was $"), price, F.lit(" today."))
    return p.select(F.col("p_partkey").cast("string").alias("corpus_id"), F.lit(0).cast("long").alias("source_ord"), F.concat(F.lit("part_"), F.col("p_partkey")).alias("source_id"), content.alias("content"))


def price_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims about parts' prices: every third ten times too high, of the rest every fifth approximate."""
    p = read(spark, sf, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    told = F.when(F.col("p_partkey") % 3 == 0, (price * 10).cast("decimal(18,2)")).otherwise(price).cast("string")
    hedge = F.when(F.col("p_partkey") % 5 == 0, "approximately ").otherwise("")
    claim = F.concat(F.lit("The retail price is "), hedge, F.lit("$"), told, F.lit(" today."))
    return p.select(F.col("p_partkey").cast("string").alias("claim_id"), F.col("p_partkey").cast("string").alias("corpus_id"), claim.alias("claim"))


def lines_of(spark: SparkSession, sf: str) -> DataFrame:
    """documents' lines as paragraphs; every fifth is a heading."""
    d = read(spark, sf, "documents")
    x = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return x.withColumn("style", F.when(F.col("ord") % 5 == 0, "Heading 1").otherwise("Normal"))


def clause_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses about customers in four forms."""
    c = read(spark, sf, "customer")
    n, k = F.col("c_name"), F.col("c_custkey")
    forms = (
        F.when(k % 4 == 0, F.concat(F.lit("The Total Fee shall not be exceeded by "), n, F.lit(".")))
        .when(k % 4 == 1, F.concat(F.lit("The Service Charge shall be determined by "), n, F.lit(" subject to the Master Agreement.")))
        .when(k % 4 == 2, F.concat(F.lit("Permitted Costs is defined as costs of "), n, F.lit(" in Schedule One")))
        .otherwise(F.concat(n, F.lit(" may not assign the Permitted Costs, pursuant to Clause Nine, without the Total Fee.")))
    )
    return c.select(k.cast("string").alias("clause_id"), F.lit("legal").alias("corpus_id"), forms.alias("clause"))


def term_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions from nations, the later ones of a region replacing the earlier."""
    n = read(spark, sf, "nation")
    terms = F.element_at(F.array(*map(F.lit, ("Permitted Costs", "Total Fee", "Service Charge", "Master Agreement", "Delivery Date"))), (F.col("n_regionkey") + 1).cast("int"))
    content = F.concat(F.lit('"'), terms, F.lit('" means what '), F.col("n_name"), F.lit(" says."))
    kind = F.when(F.col("n_nationkey") % 7 == 6, "legal_clause").otherwise("legal_definition")
    return n.select(F.lit("legal").alias("corpus_id"), F.col("n_nationkey").cast("long").alias("source_ord"), F.concat(F.lit("def_"), F.col("n_nationkey")).alias("source_id"), content.alias("content"), kind.alias("source_type"))


def status_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A status for each order, from its key, grouped by customer."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey") % 10
    status = F.when(k < 5, "VERIFIED").when(k < 6, "CONTRADICTED").when(k < 9, "UNVERIFIABLE").otherwise("ERROR")
    return o.select(F.col("o_custkey").alias("analysis_id"), F.col("o_orderkey"), status.alias("status"))


def response_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Responses about benchmark items in JSON, some of them invalid, some fenced."""
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("t"))
    i = F.col("item_id")
    label = F.when(i % 3 == 0, "Entailment").when(i % 3 == 1, "Contradiction").otherwise("Neutral")
    status = F.when(i % 3 == 0, "VERIFIED").when(i % 3 == 1, "CONTRADICTED").otherwise("UNVERIFIABLE")
    excerpt = F.when(i % 4 == 3, F.lit(None).cast("string")).otherwise(F.col("t"))
    reasons = F.when(i % 8 == 3, F.array(F.lit("sum of two figures")))
    check = F.struct(F.col("t").alias("claim_text"), status.alias("status"), F.concat(F.lit("s"), i % 5).alias("source_id"), excerpt.alias("source_excerpt"), reasons.alias("reasoning_basis"))
    used = F.array(F.struct(F.concat(F.lit("s"), i % 5).alias("source_id"), F.lit("Supporting").alias("role")), F.struct(F.lit("s99").alias("source_id"), F.lit("Supporting").alias("role")), F.struct(F.lit("s1").alias("source_id"), F.lit("Not Used").alias("role")))
    whole = F.struct(
        F.struct(label.alias("label"), (F.when(i % 7 == 6, 1.5).otherwise(0.5)).alias("probability")).alias("textual_entailment"),
        F.struct(F.lit(50.0).alias("percentage")).alias("conceptual_coverage"),
        F.lit(75.0).alias("factual_consistency_score"),
        F.array(check).alias("verifications"),
        used.alias("source_attributions"),
        F.concat(F.lit("Verdict "), i).alias("overall_verdict"),
    )
    json = F.to_json(whole)
    content = F.when(i % 2 == 1, F.concat(F.lit("Here it is:\n```json\n"), json, F.lit("\n```\nDone."))).otherwise(json)
    return b.select(i, F.col("t"), F.when(i % 11 == 10, "no JSON here").otherwise(content).alias("content"))


# --- sources ---------------------------------------------------------------------------------------------


@query
def q_chunk_whole(spark, sf):
    """Each document as one chunk."""
    return whole_chunks(doc_sources(spark, sf)).select("source_id", "char_start", "char_end", "text_content")


@query
def q_chunk_window(spark, sf):
    """Documents over 200 tokens in windows of 100 words, 20 of them shared."""
    cfg = Config(chunk_size=100, chunk_overlap=20, max_source_tokens=200)
    return chunk_sources(doc_sources(spark, sf), cfg).select("source_id", "chunk_ord", "char_start", "char_end", F.md5("text_content").alias("text_md5"))


@query
def q_row_sources(spark, sf):
    """Parts as `Header: value` sources."""
    p = read(spark, sf, "part")
    cols = {"Name": F.col("p_name"), "Brand": F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")), "Size": F.col("p_size"), "Retail price": F.col("p_retailprice").cast("decimal(18,2)")}
    return tables.row_sources(p, "Part list", F.col("p_partkey"), cols).select("source_id", "content", "source_type")


@query
def q_financial_rows(spark, sf):
    """Orders as rows of a financial table."""
    o = read(spark, sf, "orders")
    cols = {"Order": F.col("o_orderkey"), "Total": F.col("o_totalprice").cast("decimal(18,2)"), "Priority": F.col("o_orderpriority")}
    return tables.financial_rows(o, "Orders", F.col("o_orderkey"), cols).select("source_id", "content", "source_type")


@query
def q_doc_sections(spark, sf):
    """Documents' lines in sections from heading to heading."""
    return tables.sections(lines_of(spark, sf)).select("doc_id", "source_id", F.md5("content").alias("content_md5"), F.length("content").alias("n_chars"))


@query
def q_doc_paragraphs(spark, sf):
    return tables.paragraph_sources(lines_of(spark, sf)).select("doc_id", "source_id", F.md5("content").alias("content_md5"))


@query
def q_legal_sections(spark, sf):
    """Definitions told from clauses by their wording."""
    d = term_rows(spark, sf).select((F.col("source_ord") / 5).cast("int").cast("long").alias("doc_id"), (F.col("source_ord") % 5).cast("int").alias("ord"), F.when(F.col("source_ord") % 2 == 0, "Heading 2").otherwise("Normal").alias("style"), F.when(F.col("source_ord") % 3 == 0, F.lit(" plain words ")).otherwise(F.col("content")).alias("text"))
    return tables.legal_sections(d).select("doc_id", "source_id", "source_type", "content")


@query
def q_retrieved_sources(spark, sf):
    """Conversation turns as retrieved items, named by metadata or position."""
    c = read(spark, sf, "conversations")
    meta = c.withColumn("metadata", F.when(F.col("role") == "user", F.create_map(F.lit("source"), F.concat(F.lit("conv_"), F.col("conv_id")))))
    return tables.retrieved_sources(meta, "text", "metadata", "turn").select("conv_id", "turn", "source_id", F.length("content").alias("n_chars"))


@query
def q_sources_dedup(spark, sf):
    """Texts added in three steps; the first of each wins, the last step is a model's."""
    d = read(spark, sf, "documents").select(F.md5("text").alias("source_id"), (F.col("doc_id") % 3).alias("step"), "doc_id")
    return accumulate.first_of_each(d, ["source_id"], ["step", "doc_id"], llm_steps=[2])


@query
def q_has_llm_derived(spark, sf):
    d = doc_sources(spark, sf).withColumn("derived_from_llm", F.col("source_ord") % 97 == 5)
    return accumulate.has_model_text(d)


@query
def q_boundary_context(spark, sf):
    """Each line's neighbouring sentences."""
    x = accumulate.with_boundary_context(lines_of(spark, sf), "doc_id", "ord", "text")
    return x.select("doc_id", "ord", F.md5("prev_context").alias("prev_md5"), F.md5("next_context").alias("next_md5"))


@query
def q_terms(spark, sf):
    """Defined terms, the last definition of each."""
    return accumulate.terms(term_rows(spark, sf)).select("term", "source_id", "content")


# --- text ------------------------------------------------------------------------------------------------


@query
def q_atoms(spark, sf):
    """Documents' sentences, classified."""
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(tx.classified_atoms(F.col("text"))).alias("n", "a"))
    return d.select("doc_id", "n", F.col("a.claim_text").alias("claim_text"), F.col("a.claim_type").alias("claim_type"))


@query
def q_claim_type(spark, sf):
    """Types of claims with and without a signal word."""
    p = read(spark, sf, "part")
    signal = F.element_at(F.array(*map(F.lit, ("This suggests a rise.", "The trend is up.", "Trendy goods.", "Sales are EXPECTED TO grow.", "It is likely so."))), (F.col("p_partkey") % 5 + 1).cast("int"))
    claim = F.concat(F.col("p_name"), F.lit(" costs 3.5 or so! "), signal)
    return p.select("p_partkey", F.posexplode(tx.classified_atoms(claim)).alias("n", "a")).select("p_partkey", "n", "a.claim_text", "a.claim_type")


@query
def q_sentences(spark, sf):
    """Turns' sentences with terminators."""
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("n", "sentence"))


@query
def q_pronoun_units(spark, sf):
    """Sentences that begin with a pronoun get the one before them."""
    s = q_sentences(spark, sf).withColumn("sentence", F.when(F.col("n") % 3 == 1, F.concat(F.lit("It, "), F.col("sentence"))).otherwise(F.col("sentence")))
    per = s.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("n", "sentence"))).alias("u"))
    x = per.select("conv_id", "turn", F.posexplode("u").alias("n", "x"), "u")
    pronoun = tx.starts_with_pronoun(F.col("x.sentence"))
    return x.select("conv_id", "turn", "n", F.when(pronoun, "llm_coreference").otherwise("none").alias("enrichment_method"), F.when(pronoun & (F.col("n") > 0), F.get("u", F.col("n") - 1)["sentence"]).alias("preceding_sentence"))


@query
def q_flatten_struct(spark, sf):
    """Nested orders as dotted lines."""
    o = read(spark, sf, "orders")
    s = F.struct(F.struct(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("priority"), (F.col("o_custkey") % 2 == 0).alias("even")).alias("order"), F.array(F.struct(F.col("o_orderstatus").alias("code")), F.struct(F.lit("x").alias("code"))).alias("states"))
    x = o.select("o_orderkey", s.alias("rec"))
    return x.select("o_orderkey", tx.flattened(F.col("rec"), x.schema["rec"].dataType).alias("claim"))


@query
def q_clause_decompose(spark, sf):
    d = clauses.decompose(clause_rows(spark, sf))
    return d.select("clause_id", "main_proposition", "modal_operator", F.array_join("subordinate_modifiers", "|").alias("modifiers"), F.array_join("defined_terms", "|").alias("terms"), clauses.obligation_context().alias("context"))


@query
def q_clause_sources(spark, sf):
    """Definitions of the terms that each clause uses."""
    return clauses.term_sources(clauses.decompose(clause_rows(spark, sf)), accumulate.terms(term_rows(spark, sf))).select("clause_id", "ord", "term", "source_id")


@query
def q_response_text(spark, sf):
    """JSON found in fenced, thinking and plain responses."""
    r = response_rows(spark, sf)
    i = F.col("item_id")
    said = F.when(i % 5 == 1, F.concat(F.lit("<think>so {x}</think>"), F.col("content"))).when(i % 5 == 2, F.concat(F.lit("<think>"), F.col("content"))).when(i % 5 == 3, F.lit("")).otherwise(F.col("content"))
    kind = F.when(i % 2 == 0, "ollama").otherwise("default")
    return r.select("item_id", response_text(kind, said, F.when(i % 10 == 8, F.lit(' {"a": 1} '))).alias("json"))


@query
def q_json_substring(spark, sf):
    """Claims listed in extraction responses."""
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("t"))
    listed = F.to_json(F.struct(F.array("t", F.lit("second")).alias("claims")))
    said = F.when(F.col("item_id") % 4 == 0, listed).when(F.col("item_id") % 4 == 1, F.concat(F.lit("Sure: "), listed, F.lit(" ok"))).when(F.col("item_id") % 4 == 2, F.lit('["only", "a list"]')).otherwise("none")
    return b.select("item_id", F.array_join(responses.parse_claims(said), "|").alias("claims"))


@query
def q_answer_prompt(spark, sf):
    """Blocks of the faithfulness prompt: sources with their context and numbered sentences."""
    x = accumulate.with_boundary_context(lines_of(spark, sf), "doc_id", "ord", "text")
    per = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("text").alias("text_content"), "prev_context", "next_context"))).alias("c"))
    block = F.array_join(F.transform("c", prompts.with_context), "\n\n")
    return per.select("doc_id", F.md5(block).alias("sources_md5"), F.md5(prompts.numbered(F.transform("c", lambda c: c["text_content"]))).alias("sentences_md5"))


@query
def q_adapter_lookup(spark, sf):
    """Adapters of model names by first prefix."""
    n = read(spark, sf, "nation")
    names = ("ollama/llama3", "ollama_chat/qwen3", "nvidia_nim/deepseek-r1", "nvidia_nim/nvidia/nemotron-3-super-120b", "nvidia_nim/nvidia/nemotron-3-nano", "nvidia_nim/moonshotai/kimi-k2", "nvidia_nim/openai/gpt-oss", "nvidia_nim/microsoft/phi-4-mini-instruct", "vertex_ai/gemini-2", "gemini/flash", "anthropic/claude", "claude-3", "o1-mini", "o3", "o4-mini", "gpt-5", "gpt-4o", "mistral")
    model = F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % len(names) + 1).cast("int"))
    return n.select("n_nationkey", model.alias("model"), adapter(model).alias("adapter"))


# --- retrieval -------------------------------------------------------------------------------------------


@query
def q_bm25_stats(spark, sf):
    """Document frequency and weight of each corpus's tokens."""
    corpus, idf, _ = retrieval.token_stats(whole_chunks(doc_sources(spark, sf)))
    return idf.join(corpus, "corpus_id").select("corpus_id", "token", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


@query
def q_bm25_scores(spark, sf):
    """Scores of claims and the chunks of their corpus that share a token."""
    s = retrieval.scores(bench_claims(spark, sf), whole_chunks(doc_sources(spark, sf)))
    return s.where("score <> 0").select("claim_id", "source_ord", F.round("score", 6).alias("score"))


@query
def q_bm25_topk(spark, sf):
    claims, chunks = bench_claims(spark, sf), whole_chunks(doc_sources(spark, sf))
    t = retrieval.top_chunks(retrieval.scores(claims, chunks), claims, chunks, 6)
    return t.select("claim_id", "source_ord", "rank")


def _routed(spark, sf, threshold):
    claims, chunks = bench_claims(spark, sf), whole_chunks(doc_sources(spark, sf))
    scored = retrieval.scores(claims, chunks)
    return scored, retrieval.routes(scored, claims, chunks, threshold, GENERAL.top_k)


@query
def q_bm25_route(spark, sf):
    """Routes at a threshold that lets some claims pass and sends others to review."""
    return _routed(spark, sf, 40.0)[1].select("claim_id", "decision", F.round("highest_score", 6).alias("highest_score"), "n_chunks")


@query
def q_lexical_results(spark, sf):
    """Results of claims that pass by lexical score."""
    scored, routed = _routed(spark, sf, 40.0)
    claims = bench_claims(spark, sf).withColumn("atoms", tx.classified_atoms(F.col("claim"))).join(routed.where(F.col("decision") == LEXICAL_PASS).select("claim_id"), "claim_id", "left_semi")
    chunks = whole_chunks(doc_sources(spark, sf))
    r = results.lexical_results(claims, retrieval.routed_chunks(scored, routed, chunks, 6), chunks)
    a = F.get("atomic_claims", F.lit(0))
    return r.select("claim_id", "status", "verification_method", "factual_consistency_score", F.array_join("sources_used", ",").alias("sources_used"), a["claim_type"].alias("claim_type"), a["citation"]["source_id"].alias("cited"), a["citation"]["excerpt_char_end"].alias("excerpt_end"))


def _evidence(spark, sf):
    """Claims with evidence: words of the item, or letters that share no token."""
    quote = F.when(F.col("input_ord") % 3 == 0, F.lit("zzqx yyqw")).otherwise(F.substring_index("claim", " ", 3))
    return bench_claims(spark, sf).withColumn("evidence", quote)


@query
def q_fuzzy_gate(spark, sf):
    """Whether each claim's evidence is in its corpus, and the first chunk that has it."""
    g = fuzzy.evidence_gate(_evidence(spark, sf), whole_chunks(doc_sources(spark, sf)))
    return g.select("claim_id", F.when(F.col("passed"), F.col("source_id")).alias("source_id"), "passed")


@query
def q_fuzzy_disjoint(spark, sf):
    """Every claim's best chunk and similarity; letter by letter where no token is shared."""
    m = fuzzy.evidence_matches(_evidence(spark, sf), whole_chunks(doc_sources(spark, sf)))
    return m.select("claim_id", "source_id", F.round("similarity", 6).alias("similarity"))


@query
def q_pinned_chunks(spark, sf):
    """Routed chunks with the evidence's chunk added."""
    chunks = whole_chunks(doc_sources(spark, sf))
    scored, routed = _routed(spark, sf, 40.0)
    gate = fuzzy.evidence_gate(_evidence(spark, sf), chunks)
    return fuzzy.with_pinned(retrieval.routed_chunks(scored, routed, chunks, 6), gate).select("claim_id", "source_id", "ord")


# --- numbers ---------------------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("raw", T.StringType())])))
def _numbers(text):
    return text.map(lambda t: [{"value": n.value, "raw": n.raw} for n in find_numbers(prepared(t), False)])


@query
def q_mask_structural(spark, sf):
    """Texts with labelling numbers, masked."""
    p = read(spark, sf, "part")
    t = F.concat(F.lit("Section "), F.col("p_size"), F.lit(" has [12] and "), F.col("p_partkey"), F.lit(" items on page "), F.col("p_size"), F.lit("."))
    return p.select("p_partkey", masked_structural(t).alias("masked"))


@query
def q_number_forms(spark, sf):
    """Accounting negatives and European decimals, normalised."""
    p = read(spark, sf, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    t = F.concat(F.lit("Loss ($"), price, F.lit(") or "), F.col("p_size"), F.lit(",50 each"))
    return p.select("p_partkey", normal_european(normal_accounting(t)).alias("normal"))


@query
def q_numbers(spark, sf):
    """Numbers read from sentences about parts."""
    s = part_sources(spark, sf).select("corpus_id", F.posexplode(_numbers("content")).alias("n", "x"))
    return s.select("corpus_id", "n", F.round("x.value", 6).alias("value"), "x.raw")


@query
def q_years(spark, sf):
    """Years in context from sentences about orders."""
    o = read(spark, sf, "orders")
    y = F.year("o_orderdate").cast("string")
    t = F.concat(F.lit("Placed in "), y, F.lit(" and "), (F.year("o_orderdate") + 1).cast("string"), F.lit(", code 1234, FY"), y)
    return o.select("o_orderkey", F.array_join(years_in_context(t), ",").alias("years"))


@query
def q_number_conflict(spark, sf):
    """Price claims held against the parts' sentences."""
    c = numeric.check_claims(price_claims(spark, sf), whole_chunks(part_sources(spark, sf)))
    return c.select("claim_id", "has_conflict", "escalate_reason", F.col("citation.excerpt").alias("excerpt"), F.col("citation.excerpt_char_start").alias("excerpt_start"))


@query
def q_range_conflict(spark, sf):
    """Size ranges held against sizes: inside, outside, or wider."""
    p = read(spark, sf, "part")
    s, k = F.col("p_size"), F.col("p_partkey") % 3
    claim = F.concat(F.lit("The size lies between "), F.when(k == 0, s - 1).when(k == 1, s + 5).otherwise(s + 1), F.lit(" and "), F.when(k == 0, s + 1).when(k == 1, s + 9).otherwise(s + 2), F.lit(" units here"))
    source = F.concat(F.lit("The size is "), F.when(k == 2, F.concat(s, F.lit(" to "), s + 4)).otherwise(s.cast("string")), F.lit(" units here"))
    claims = p.select(F.col("p_partkey").cast("string").alias("claim_id"), F.col("p_partkey").cast("string").alias("corpus_id"), claim.alias("claim"))
    src = p.select(F.col("p_partkey").cast("string").alias("corpus_id"), F.lit(0).cast("long").alias("source_ord"), F.lit("s").alias("source_id"), source.alias("content"))
    return numeric.check_claims(claims, whole_chunks(src)).select("claim_id", "has_conflict", "escalate_reason")


@query
def q_conflict_fast_exit(spark, sf):
    """Results of conflicting claims."""
    claims = price_claims(spark, sf).withColumn("atoms", tx.classified_atoms(F.col("claim")))
    src = part_sources(spark, sf)
    first = src.groupBy("corpus_id").agg(F.min_by("source_id", "source_ord").alias("first_source"))
    r = results.numeric_results(numeric.check_claims(claims, whole_chunks(src)), claims, first)
    return r.select("claim_id", "status", "verification_method", "factual_consistency_score", F.array_join("sources_used", ",").alias("sources_used"), "offending_claim")


@query
def q_evidence_bundle(spark, sf):
    """The first three chunks of each corpus that hold a digit as a number."""
    return numeric.evidence_bundle(whole_chunks(doc_sources(spark, sf))).select("corpus_id", "source_id", "place")


# --- results ---------------------------------------------------------------------------------------------


@query
def q_response_validate(spark, sf):
    """Which responses are valid, and why others are not."""
    r = results_in(spark, sf)
    return r.select("item_id", "valid", "error")


def results_in(spark, sf):
    r = response_rows(spark, sf)
    return responses.validated(r.withColumn("content", tx.strip_fences(F.col("content"))))


@query
def q_llm_result(spark, sf):
    """Valid responses as results, with downgrades and struck-out sources."""
    ids = F.array(*[F.lit(f"s{i}") for i in range(5)])
    a = results_in(spark, sf).where("valid").select(F.col("item_id").cast("string").alias("claim_id"), F.lit("c").alias("corpus_id"), F.array(F.struct(F.col("t").alias("claim_text"), F.when(F.col("item_id") % 2 == 0, "Extractive").otherwise("Inferential").alias("claim_type"))).alias("atoms"), "response", F.lit("tier3_llm").alias("method"), ids.alias("source_ids"), F.create_map(F.lit("s1"), F.lit("p. 4")).alias("page_hints"), F.array(F.lit("s2")).alias("bundle_ids"), F.lit(0.001).alias("cost_usd"))
    r = results.model_results(a)
    one = F.get("atomic_claims", F.lit(0))
    return r.select("claim_id", "status", "is_valid", "factual_consistency_score", F.array_join("sources_used", ",").alias("sources_used"), "offending_claim", one["status"].alias("atom_status"), one["claim_type"].alias("claim_type"), one["unverifiable_reason"].alias("unverifiable_reason"), one["page_hint"].alias("page_hint"), one["citation"]["citation_confidence"].alias("confidence"))


@query
def q_analysis_aggregate(spark, sf):
    """Statuses summed up by analysis."""
    a = results.analysis_summary(status_rows(spark, sf))
    return a.select("analysis_id", "total_units", "grounded_units", "ungrounded_units", "unverifiable_units", F.round("score", 6).alias("score"), "status", "is_grounded")


def verdict_rows(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("n", "s"))
    k = (F.length("s") + F.col("turn")) % 16
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "conv_id", "turn", F.when(k < 13, "Entailment").when(k < 15, "Neutral").otherwise("Contradiction").alias("verdict"))


@query
def q_answer_faithfulness(spark, sf):
    """Verdicts on sentences summed up by answer."""
    f = results.faithfulness_summary(verdict_rows(spark, sf))
    return f.select("answer_id", "total", "entailed", F.round("score", 6).alias("score"), "status", "is_grounded")


@query
def q_majority_vote(spark, sf):
    """Three evaluations of each order, their majority or their tie."""
    o = read(spark, sf, "orders")
    v = o.select(F.col("o_orderkey").alias("answer_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("vote"), F.col("o_custkey").alias("c"))
    k = (F.col("answer_id") * 7 + F.col("vote") * (F.col("c") % 5)) % 10
    v = v.select("answer_id", "vote", F.when(k < 3, "NOT_GROUNDED").when(k < 7, "GROUNDED").otherwise("PARTIALLY_GROUNDED").alias("status"), (k / 10).alias("score"))
    m = results.majority(v, threshold=0.5)
    return m.select("answer_id", "status", F.round("score", 6).alias("score"), "tie_broken", "is_grounded")


@query
def q_accumulator(spark, sf):
    """Conversations' scores from their turns; every third conversation has no unit counts."""
    f = results.faithfulness_summary(verdict_rows(spark, sf)).withColumn("conv_id", F.substring_index("answer_id", "-", 1).cast("long"))
    some = F.when(F.col("conv_id") % 3 == 0, 0).otherwise(1)
    x = f.withColumns({"grounded_units": F.col("entailed") * some, "ungrounded_units": (F.col("total") - F.col("entailed")) * some})
    a = results.accumulated(x, "conv_id")
    return a.select("conv_id", F.round("overall_score", 6).alias("overall_score"), "is_grounded", "n_results")


@query
def q_spend_cap(spark, sf):
    """Running spend of each customer's orders and what it leaves out."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("input_ord"), "o_custkey", ((F.col("o_orderkey") % 7 + 1) / 8).alias("cost_usd"))
    s = results.spend_capped(o, 1.5, group="o_custkey")
    return s.select("input_ord", F.round("spent", 6).alias("spent"), "skipped", F.round(F.when(F.col("skipped"), 0.0).otherwise(F.col("spent")), 6).alias("total_cost_usd"))


@query
def q_cost_estimate(spark, sf):
    """Costs of checking turns against three texts."""
    c = read(spark, sf, "conversations")
    model = F.when(F.col("turn") % 4 == 0, "gpt-4o-mini").when(F.col("turn") % 4 == 1, "gpt-4o-2024").when(F.col("turn") % 4 == 2, "claude-3-5-sonnet-x").otherwise("other")
    d = c.withColumns({"texts": F.array(F.col("text"), F.lit("one two three"), F.lit("a b"), F.lit("never counted")), "model": model})
    e = costs.answer_cost(d, "text", "texts", F.col("model"), majority_vote=True)
    return e.select("conv_id", "turn", "input_tokens", "output_tokens", F.round("total_usd", 9).alias("total_usd"))


@query
def q_analysis_cost(spark, sf):
    c = read(spark, sf, "conversations").withColumn("texts", F.array(F.lit("one two three")))
    e = costs.analysis_cost(c, "text", "texts", F.lit("gemini-1.5-pro"))
    return e.select("conv_id", "turn", "input_tokens", "output_tokens", F.round("total_usd", 9).alias("total_usd"))


@query
def q_resume_antijoin(spark, sf):
    """Documents without a label are still to do."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "source")
    done = read(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    return results.unprocessed(d, done)


@query
def q_rag_metrics(spark, sf):
    """Statuses counted by sample, against labels derived from two marks."""
    m = results.benchmark_metrics(status_rows(spark, sf).withColumnRenamed("analysis_id", "sample_id"))
    l = read(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("hallucinated"))  # noqa: E741
    return m.join(l, "sample_id").select("sample_id", "n_units", "contradicted_count", "unverifiable_count", "has_contradiction", F.round("unverifiable_ratio", 6).alias("unverifiable_ratio"), "hallucinated")


# --- whole plans -----------------------------------------------------------------------------------------


@query
def q_verify_cascade(spark, sf):
    """The deterministic cascade on price claims: conflicts, lexical passes, and what stays open."""
    r = verify(price_claims(spark, sf), part_sources(spark, sf), Config())
    return r.select("claim_id", "status", "verification_method")


@query
def q_verify_claims(spark, sf):
    """Benchmark claims through the whole cascade with an offline judge."""
    r = verify(bench_claims(spark, sf), doc_sources(spark, sf), Config(), Overlap())
    return r.select("claim_id", "status", "verification_method", F.round("factual_consistency_score", 6).alias("factual_consistency_score"))


@query
def q_verify_answer(spark, sf):
    """Assistant turns held against the earlier turns of their conversation."""
    c = read(spark, sf, "conversations")
    last = c.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.max("turn").alias("turn"))
    src = c.join(last.select("conv_id", F.col("turn").alias("t")), "conv_id").where("turn < t").select(F.col("conv_id").cast("string").alias("corpus_id"), F.col("turn").alias("source_ord"), F.concat(F.lit("turn_"), F.col("turn")).alias("source_id"), F.col("text").alias("content"))
    r = verify_answer(last.select(F.col("conv_id").alias("answer_id"), F.col("conv_id").alias("corpus_id"), "answer"), src, Overlap(share=0.5))
    return r.select("answer_id", "status", F.round("score", 6).alias("score"), "is_grounded")


@query
def q_verify_analysis(spark, sf):
    """Benchmark items as analyses of their corpus."""
    b = bench_claims(spark, sf).select(F.col("claim_id").alias("analysis_id"), "corpus_id", F.col("claim").alias("text"))
    r = verify_analysis(b, doc_sources(spark, sf), Overlap())
    return r.select("analysis_id", "status", "total_units", F.round("score", 6).alias("score"))


@query
def q_verify_clause(spark, sf):
    """Clauses held against the definitions of their terms."""
    src = term_rows(spark, sf)
    r = verify_clause(clause_rows(spark, sf), src, accumulate.terms(term_rows(spark, sf)), evaluator=Overlap())
    return r.select("claim_id", "status", "verification_method")


@query
def q_verify_structured(spark, sf):
    """Nested order records held against the same facts in a sentence."""
    o = read(spark, sf, "orders")
    rec = F.struct(F.struct(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority")).alias("order"))
    records = o.select(F.col("o_orderkey").cast("string").alias("claim_id"), F.col("o_orderkey").cast("string").alias("corpus_id"), rec.alias("rec"))
    src = o.select(F.col("o_orderkey").cast("string").alias("corpus_id"), F.lit(0).cast("long").alias("source_ord"), F.lit("s").alias("source_id"), F.concat(F.lit("order.state: "), F.col("o_orderstatus"), F.lit("\norder.priority: "), F.col("o_orderpriority")).alias("content"))
    r = verify_structured(records, "rec", src, evaluator=Overlap())
    return r.select("claim_id", "status", "verification_method")


