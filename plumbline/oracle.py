"""DuckDB SQL for the queries of queries.py that SQL can express."""

from __future__ import annotations

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_ATOM_LIST = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, "
    + r"'(^|[^0-9])[.!?]\s+', '\1' || chr(30), 'g'), '\n+', chr(30), 'g'), chr(30)), lambda x: "
    + _STRIP.format("x")
    + "), lambda x: x <> '')"
)
_SENTENCE_LIST = (
    "list_filter(list_transform(string_split(regexp_replace({t}, "
    + r"'([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: "
    + _STRIP.format("x")
    + "), lambda x: x <> '')"
)
_SIGNALS = "trend|trajectory|suggests|indicates|on track|at risk|appears to|likely|projected|based on|derived from|analysis shows|pattern|forecast|outlook|implies|consistent with|points to|expected to"
_TYPE = rf"CASE WHEN regexp_matches(lower({{}}), '\b(?:{_SIGNALS})\b') THEN 'Inferential' ELSE 'Extractive' END"
_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"

_CLAIMS = "SELECT item_id::VARCHAR AS claim_id, 'src' || (item_id % 20) AS corpus_id, text AS claim, item_id FROM benchmark"

_BM25 = f"""
sp AS (SELECT source AS corpus_id, doc_id AS source_ord, {_WORDS.format("lower(text)")} AS w FROM documents),
sizes AS (SELECT corpus_id, count(*) AS n, avg(len(w)) AS avgdl FROM sp GROUP BY 1),
tok AS (SELECT corpus_id, source_ord, unnest(w) AS token FROM sp),
tf AS (SELECT corpus_id, source_ord, token, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
dfs AS (SELECT corpus_id, token, count(*) AS df FROM tf GROUP BY 1, 2),
raw AS (SELECT corpus_id, token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM dfs JOIN sizes USING (corpus_id)),
mean AS (SELECT corpus_id, avg(raw_idf) AS mean_idf FROM raw GROUP BY 1),
idf AS (SELECT corpus_id, token, df, CASE WHEN raw_idf < 0 THEN 0.25 * mean_idf ELSE raw_idf END AS idf FROM raw JOIN mean USING (corpus_id)),
claims AS ({_CLAIMS}),
q AS (SELECT claim_id, corpus_id, token, count(*) AS times FROM (SELECT claim_id, corpus_id, unnest({_WORDS.format("lower(claim)")}) AS token FROM claims) GROUP BY 1, 2, 3),
lens AS (SELECT corpus_id, source_ord, len(w) AS length FROM sp),
summed AS (SELECT claim_id, corpus_id, source_ord, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) AS score
  FROM q JOIN idf USING (corpus_id, token) JOIN tf USING (corpus_id, token) JOIN lens USING (corpus_id, source_ord) JOIN sizes USING (corpus_id) GROUP BY 1, 2, 3),
scored AS (SELECT claim_id, corpus_id, source_ord, round(coalesce(score, 0), 9) AS score FROM (SELECT claim_id, corpus_id, source_ord FROM claims JOIN lens USING (corpus_id)) LEFT JOIN summed USING (claim_id, corpus_id, source_ord)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, source_ord DESC) AS rank, row_number() OVER (PARTITION BY claim_id ORDER BY source_ord) AS place FROM scored),
tops AS (SELECT claim_id, corpus_id, max(score) AS raw, count(*) AS n_chunks FROM scored GROUP BY 1, 2),
routed AS (SELECT claim_id, corpus_id, greatest(raw, 0) AS highest_score, n_chunks,
  CASE WHEN greatest(raw, 0) >= 40 THEN 'lexical_pass' WHEN greatest(raw, 0) <= 0.01 AND (raw >= 0 OR n_chunks <= 6) THEN 'all_low_escalate' ELSE 'semantic_review' END AS decision FROM tops),
looked AS (SELECT claim_id, corpus_id, source_ord, CASE WHEN decision = 'all_low_escalate' THEN place ELSE rank END AS ord
  FROM ranked JOIN routed USING (claim_id, corpus_id) WHERE CASE WHEN decision = 'all_low_escalate' THEN place <= 18 ELSE rank <= 6 END)
"""
_EVIDENCE = f"""
ev AS (SELECT claim_id, corpus_id, item_id, CASE WHEN item_id % 3 = 0 THEN 'zzqx yyqw' ELSE array_to_string(string_split(claim, ' ')[1:3], ' ') END AS evidence FROM ({_CLAIMS})),
shared AS (SELECT claim_id, corpus_id, min(doc_id) AS source_ord FROM ev JOIN documents ON source = corpus_id
  WHERE len(list_intersect({_WORDS.format("evidence")}, {_WORDS.format("text")})) > 0 GROUP BY 1, 2)
"""
_PRICE = "p_retailprice::DECIMAL(18,2)"
_TOLD = f"(CASE WHEN p_partkey % 3 = 0 THEN ({_PRICE} * 10)::DECIMAL(18,2) ELSE {_PRICE} END)"
_CLASH = "(p_partkey % 3 = 0)"
_CLAUSES = """
cl AS (SELECT c_custkey::VARCHAR AS clause_id, CASE c_custkey % 4
  WHEN 0 THEN 'The Total Fee shall not be exceeded by ' || c_name || '.'
  WHEN 1 THEN 'The Service Charge shall be determined by ' || c_name || ' subject to the Master Agreement.'
  WHEN 2 THEN 'Permitted Costs is defined as costs of ' || c_name || ' in Schedule One'
  ELSE c_name || ' may not assign the Permitted Costs, pursuant to Clause Nine, without the Total Fee.' END AS clause FROM customer),
de AS (SELECT clause_id, clause,
  CASE WHEN clause LIKE '% shall not be exceeded by %' THEN regexp_replace(clause, '^(.+?) shall not be exceeded by (.+?)\\.?$', '\\2 shall not exceed \\1')
       WHEN clause LIKE '% shall be determined by %' THEN regexp_replace(clause, '^(.+?) shall be determined by (.+?)\\.?$', '\\2 shall determine \\1')
       WHEN clause LIKE '% is defined as % in %' THEN regexp_replace(clause, '^(.+?) is defined as (.+?) in (.+?)\\.?$', '\\3 defines \\1 as \\2')
       ELSE clause END AS main_proposition,
  regexp_extract_all(clause, '(?i)(?:as defined in|pursuant to|subject to|in accordance with|as set forth in)\\s+[^,\\.]+') AS mods,
  list_filter(regexp_extract_all(clause, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1), lambda t: len(t) >= 4 AND t NOT IN ('This','That','These','Those','The','Each','Any','All','Such','Said','When','Where','Which','With','Upon','After','Before','During','Within','Without','Unless','Until')) AS found FROM cl),
dt AS (SELECT clause_id, main_proposition, mods, list_filter(found, lambda t, i: list_position(found, t) = i) AS terms,
  CASE WHEN regexp_matches(main_proposition, '(?i)\\bshall not\\b') THEN 'shall not' WHEN regexp_matches(main_proposition, '(?i)\\bshall\\b') THEN 'shall'
       WHEN regexp_matches(main_proposition, '(?i)\\bmay not\\b') THEN 'may not' WHEN regexp_matches(main_proposition, '(?i)\\bmay\\b') THEN 'may'
       WHEN regexp_matches(main_proposition, '(?i)\\bmust\\b') THEN 'must' END AS modal_operator FROM de)
"""
_TERMS = """
tr AS (SELECT n_nationkey AS source_ord, 'def_' || n_nationkey AS source_id,
  ['Permitted Costs', 'Total Fee', 'Service Charge', 'Master Agreement', 'Delivery Date'][n_regionkey + 1] AS named, n_name, n_nationkey % 7 = 6 AS is_clause FROM nation),
td AS (SELECT lower(named) AS term, arg_max(source_id, source_ord) AS source_id, arg_max('"' || named || '" means what ' || n_name || ' says.', source_ord) AS content FROM tr WHERE NOT is_clause GROUP BY 1)
"""
_STATUS = """
st AS (SELECT o_custkey AS analysis_id, CASE WHEN o_orderkey % 10 < 5 THEN 'VERIFIED' WHEN o_orderkey % 10 < 6 THEN 'CONTRADICTED' WHEN o_orderkey % 10 < 9 THEN 'UNVERIFIABLE' ELSE 'ERROR' END AS status FROM orders)
"""
_VERDICTS = f"""
se AS (SELECT conv_id, turn, unnest({_SENTENCE_LIST.format(t="text")}) AS s FROM conversations),
ve AS (SELECT conv_id, conv_id || '-' || turn AS answer_id, CASE WHEN (len(s) + turn) % 16 < 13 THEN 'Entailment' WHEN (len(s) + turn) % 16 < 15 THEN 'Neutral' ELSE 'Contradiction' END AS verdict FROM se),
fa AS (SELECT conv_id, answer_id, count(*) AS total, count(*) FILTER (verdict = 'Entailment') AS entailed, count(*) FILTER (verdict = 'Contradiction') AS bad FROM ve GROUP BY 1, 2),
fs AS (SELECT *, entailed / total AS score, CASE WHEN bad > 0 THEN 'NOT_GROUNDED' WHEN entailed = total THEN 'GROUNDED' ELSE 'PARTIALLY_GROUNDED' END AS status FROM fa)
"""
_TOKENS = "round_even(len({}) * 1.3, 0)::BIGINT"


def _tokens(c: str) -> str:
    return _TOKENS.format(_WORDS.format(c))


_MODEL_ROW = """
re AS (SELECT item_id, text AS t, item_id % 3 AS m, item_id % 4 = 3 AS bare, item_id % 8 = 3 AS reasoned, item_id % 7 = 6 AS high, item_id % 11 = 10 AS junk FROM benchmark),
va AS (SELECT *, CASE WHEN junk THEN 'incomplete' WHEN high THEN 'probability' WHEN m < 2 AND bare AND NOT reasoned THEN 'evidence' END AS error FROM re)
"""

SQL: dict[str, str] = {
    "q_chunk_whole": "SELECT doc_id::VARCHAR AS source_id, 0 AS char_start, length(text) AS char_end, text AS text_content FROM documents",
    "q_chunk_window": r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS ws, regexp_split_to_array(text, '\S+') AS seps FROM documents),
w AS (SELECT doc_id, text, generate_subscripts(ws, 1) AS p, unnest(ws) AS word, unnest(seps[1:len(ws)]) AS sep FROM d WHERE length(text) // 4 > 200),
e AS (SELECT doc_id, text, p - 1 AS p, length(word) AS n, sum(length(sep) + length(word)) OVER (PARTITION BY doc_id ORDER BY p) AS stop, count(*) OVER (PARTITION BY doc_id) AS total FROM w),
k AS (SELECT doc_id, unnest(range(0, greatest(1, ((total - 100 + 79) // 80) + 1)::BIGINT)) AS k FROM (SELECT DISTINCT doc_id, total FROM e)),
c AS (SELECT k.doc_id, k, min(stop - n) AS a, max(stop) AS b, any_value(text) AS text FROM k JOIN e ON e.doc_id = k.doc_id AND p >= 80 * k AND p < 80 * k + 100 GROUP BY 1, 2)
SELECT doc_id::VARCHAR AS source_id, k::INT AS chunk_ord, a::INT AS char_start, b::INT AS char_end, md5(substr(text, a::BIGINT + 1, (b - a)::BIGINT)) AS text_md5 FROM c
UNION ALL SELECT doc_id::VARCHAR, 0, 0, length(text), md5(text) FROM documents WHERE length(text) // 4 <= 200
""",
    "q_row_sources": f"""
SELECT 'Part_list_row_' || p_partkey AS source_id, concat_ws(chr(10), 'Name: ' || p_name, CASE WHEN p_partkey % 4 <> 0 THEN 'Brand: ' || p_brand END, 'Size: ' || p_size, 'Retail price: ' || {_PRICE}) AS content, 'table_row' AS source_type FROM part
""",
    "q_financial_rows": """
SELECT 'Orders_row_' || o_orderkey AS source_id, concat_ws(chr(10), 'Order: ' || o_orderkey, 'Total: ' || o_totalprice::DECIMAL(18,2), 'Priority: ' || o_orderpriority) AS content, 'financial_table_row' AS source_type FROM orders
""",
    "q_doc_sections": f"""
WITH l AS ({_LINES}), p AS (SELECT doc_id, ord, {_STRIP.format("text")} AS t, sum((ord % 5 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS part FROM l),
s AS (SELECT doc_id, part, string_agg(t, chr(10) ORDER BY ord) AS content FROM p WHERE t <> '' GROUP BY 1, 2)
SELECT doc_id, 'section_' || (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1) AS source_id, md5(content) AS content_md5, length(content) AS n_chars FROM s
""",
    "q_doc_paragraphs": f"""
WITH l AS ({_LINES}) SELECT doc_id, 'para_' || ord AS source_id, md5({_STRIP.format("text")}) AS content_md5 FROM l WHERE {_STRIP.format("text")} <> ''
""",
    "q_legal_sections": f"""
WITH {_TERMS}, d AS (SELECT source_ord // 5 AS doc_id, source_ord % 5 AS ord, source_ord % 2 = 0 AS head, CASE WHEN source_ord % 3 = 0 THEN 'plain words' ELSE '"' || named || '" means what ' || n_name || ' says.' END AS t FROM tr),
p AS (SELECT *, coalesce(sum(head::INT) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS part FROM d),
s AS (SELECT doc_id, part, string_agg(t, chr(10) ORDER BY ord) AS content FROM p GROUP BY 1, 2)
SELECT doc_id::BIGINT AS doc_id, 'section_' || (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1) AS source_id, CASE WHEN contains(content, '"') AND contains(content, ' means ') THEN 'legal_definition' ELSE 'legal_clause' END AS source_type, content FROM s
""",
    "q_retrieved_sources": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'conv_' || conv_id ELSE 'source_' || turn END AS source_id, length(text) AS n_chars FROM conversations",
    "q_sources_dedup": """
WITH d AS (SELECT md5(text) AS source_id, doc_id % 3 AS step, doc_id FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY step, doc_id) AS n FROM d)
SELECT source_id, step, doc_id, step = 2 AS derived_from_llm FROM r WHERE n = 1
""",
    "q_has_llm_derived": "SELECT source AS corpus_id, count(*) AS n_sources, bool_or(doc_id % 97 = 5) AS has_llm_derived FROM documents GROUP BY 1",
    "q_boundary_context": f"""
WITH l AS ({_LINES}), x AS (SELECT doc_id, ord, lag(text) OVER w AS b, lead(text) OVER w AS a FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
y AS (SELECT *, list_filter(list_transform(string_split(b, '.'), lambda p: {_STRIP.format("p")}), lambda p: p <> '') AS parts FROM x)
SELECT doc_id, ord, md5(CASE WHEN b IS NULL THEN NULL WHEN len(parts) > 0 THEN parts[-1] || '.' ELSE b END) AS prev_md5, md5(CASE WHEN contains(a, '.') THEN split_part(a, '.', 1) || '.' ELSE a END) AS next_md5 FROM y
""",
    "q_terms": f"WITH {_TERMS} SELECT term, source_id, content FROM td",
    "q_atoms": f"""
WITH a AS (SELECT doc_id, {_ATOM_LIST.format(t="text")} AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS claim_text, generate_subscripts(l, 1) - 1 AS n FROM a)
SELECT doc_id, n, claim_text, {_TYPE.format("claim_text")} AS claim_type FROM u
""",
    "q_claim_type": f"""
WITH c AS (SELECT p_partkey, p_name || ' costs 3.5 or so! ' || ['This suggests a rise.', 'The trend is up.', 'Trendy goods.', 'Sales are EXPECTED TO grow.', 'It is likely so.'][p_partkey % 5 + 1] AS t FROM part),
a AS (SELECT p_partkey, {_ATOM_LIST.format(t="t")} AS l FROM c), u AS (SELECT p_partkey, unnest(l) AS claim_text, generate_subscripts(l, 1) - 1 AS n FROM a)
SELECT p_partkey, n, claim_text, {_TYPE.format("claim_text")} AS claim_type FROM u
""",
    "q_sentences": f"WITH a AS (SELECT conv_id, turn, {_SENTENCE_LIST.format(t='text')} AS l FROM conversations) SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS sentence FROM a",
    "q_pronoun_units": rf"""
WITH a AS (SELECT conv_id, turn, {_SENTENCE_LIST.format(t='text')} AS l FROM conversations), u AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS s FROM a),
v AS (SELECT conv_id, turn, n, CASE WHEN n % 3 = 1 THEN 'It, ' || s ELSE s END AS s FROM u),
w AS (SELECT *, lag(s) OVER (PARTITION BY conv_id, turn ORDER BY n) AS p, lower(regexp_replace(regexp_extract(s, '^\S+'), '[.,!?]+$', '')) IN ('it','he','she','they','this','that','these','those','its','their') AS pro FROM v)
SELECT conv_id, turn, n, CASE WHEN pro THEN 'llm_coreference' ELSE 'none' END AS enrichment_method, CASE WHEN pro THEN p END AS preceding_sentence FROM w
""",
    "q_flatten_struct": """
SELECT o_orderkey, 'order.key: ' || o_orderkey || chr(10) || 'order.priority: ' || coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'None') || chr(10) || 'order.even: ' || CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END || chr(10) || 'states[0].code: ' || o_orderstatus || chr(10) || 'states[1].code: x' AS claim FROM orders
""",
    "q_clause_decompose": f"""
WITH {_CLAUSES} SELECT clause_id, main_proposition, modal_operator, array_to_string(mods, '|') AS modifiers, array_to_string(terms, '|') AS terms,
  'Clause modifiers: [' || array_to_string(list_transform(mods, lambda m: '''' || m || ''''), ', ') || ']' || chr(10) || 'Obligation type: ' || coalesce(modal_operator, 'unknown') AS context FROM dt
""",
    "q_clause_sources": f"WITH {_CLAUSES}, {_TERMS}, u AS (SELECT clause_id, generate_subscripts(terms, 1) - 1 AS ord, lower(unnest(terms)) AS term FROM dt) SELECT clause_id, ord, term, source_id FROM u JOIN td USING (term)",
    "q_adapter_lookup": """
WITH m AS (SELECT n_nationkey, ['ollama/llama3','ollama_chat/qwen3','nvidia_nim/deepseek-r1','nvidia_nim/nvidia/nemotron-3-super-120b','nvidia_nim/nvidia/nemotron-3-nano','nvidia_nim/moonshotai/kimi-k2','nvidia_nim/openai/gpt-oss','nvidia_nim/microsoft/phi-4-mini-instruct','vertex_ai/gemini-2','gemini/flash','anthropic/claude','claude-3','o1-mini','o3','o4-mini','gpt-5','gpt-4o','mistral'][n_nationkey % 18 + 1] AS model FROM nation)
SELECT n_nationkey, model, CASE WHEN model LIKE 'ollama%' THEN 'ollama' WHEN model LIKE 'nvidia_nim/nvidia/%' THEN 'nemotron_nim' WHEN model LIKE 'nvidia_nim/microsoft/%' THEN 'json_object' WHEN model LIKE 'nvidia_nim/%' THEN 'nim_thinking'
  WHEN model LIKE 'vertex_ai/gemini%' OR model LIKE 'gemini/%' THEN 'google' WHEN model LIKE 'anthropic/%' OR model LIKE 'claude-%' THEN 'anthropic' WHEN regexp_matches(model, '^(o1|o3|o4|gpt-5)') THEN 'openai_reasoning' ELSE 'default' END AS adapter FROM m
""",
    "q_json_substring": """
SELECT item_id, CASE item_id % 4 WHEN 2 THEN 'only|a list' WHEN 3 THEN NULL ELSE text || '|second' END AS claims FROM benchmark
""",
    "q_answer_prompt": f"""
WITH l AS ({_LINES}), x AS (SELECT doc_id, ord, text, lag(text) OVER w AS b, lead(text) OVER w AS a FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
y AS (SELECT *, list_filter(list_transform(string_split(b, '.'), lambda p: {_STRIP.format("p")}), lambda p: p <> '') AS parts FROM x),
z AS (SELECT doc_id, ord, text, CASE WHEN b IS NULL THEN NULL WHEN len(parts) > 0 THEN parts[-1] || '.' ELSE b END AS prev, CASE WHEN contains(a, '.') THEN split_part(a, '.', 1) || '.' ELSE a END AS next FROM y)
SELECT doc_id, md5(string_agg(concat_ws(chr(10), CASE WHEN prev <> '' THEN '[preceding context: ' || prev || ']' END, text, CASE WHEN next <> '' THEN '[following context: ' || next || ']' END), chr(10) || chr(10) ORDER BY ord)) AS sources_md5,
  md5(string_agg((ord + 1) || '. ' || text, chr(10) ORDER BY ord)) AS sentences_md5 FROM z GROUP BY 1
""",
    "q_bm25_stats": f"WITH {_BM25} SELECT corpus_id, token, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM idf JOIN sizes USING (corpus_id)",
    "q_bm25_scores": f"WITH {_BM25} SELECT claim_id, source_ord, round(score, 6) AS score FROM scored WHERE score <> 0",
    "q_bm25_topk": f"WITH {_BM25} SELECT claim_id, source_ord, rank FROM ranked WHERE rank <= 6",
    "q_bm25_route": f"WITH {_BM25} SELECT claim_id, decision, round(highest_score, 6) AS highest_score, n_chunks FROM routed",
    "q_lexical_results": f"""
WITH {_BM25}, u AS (SELECT claim_id, string_agg(source_ord::VARCHAR, ',' ORDER BY ord) AS used, arg_min(source_ord, ord) AS best FROM looked GROUP BY 1)
SELECT claim_id, 'VERIFIED' AS status, 'tier2_lexical' AS verification_method, 1.0::DOUBLE AS factual_consistency_score, used AS sources_used,
  {_TYPE.format("(" + _ATOM_LIST.format(t="claim") + ")[1]")} AS claim_type, best::VARCHAR AS cited, length(text) AS excerpt_end
FROM routed JOIN u USING (claim_id) JOIN claims USING (claim_id) JOIN documents ON doc_id = best WHERE decision = 'lexical_pass'
""",
    "q_fuzzy_gate": f"WITH {_EVIDENCE} SELECT claim_id, source_ord::VARCHAR AS source_id, source_ord IS NOT NULL AS passed FROM ev LEFT JOIN shared USING (claim_id, corpus_id)",
    "q_pinned_chunks": f"""
WITH {_BM25}, {_EVIDENCE}, g AS (SELECT claim_id, corpus_id, source_ord FROM shared)
SELECT claim_id, source_ord::VARCHAR AS source_id, ord FROM looked
UNION ALL SELECT claim_id, source_ord::VARCHAR, coalesce((SELECT max(ord) FROM looked l WHERE l.claim_id = g.claim_id), 0) + 1 FROM g WHERE NOT EXISTS (SELECT 1 FROM looked l WHERE l.claim_id = g.claim_id AND l.source_ord = g.source_ord)
""",
    "q_mask_structural": """
WITH t AS (SELECT p_partkey, 'Section ' || p_size AS a, ' has ' AS b, '[12]' AS c, ' and ' || p_partkey || ' items on ' AS d, 'page ' || p_size AS e FROM part)
SELECT p_partkey, repeat(' ', length(a)) || b || '    ' || d || repeat(' ', length(e)) || '.' AS masked FROM t
""",
    "q_number_forms": f"SELECT p_partkey, 'Loss -$' || {_PRICE} || ' or ' || p_size || '.50 each' AS normal FROM part",
    "q_numbers": f"SELECT p_partkey::VARCHAR AS corpus_id, 0 AS n, round({_PRICE}::DOUBLE, 6) AS value, '$' || {_PRICE} AS raw FROM part",
    "q_years": "SELECT o_orderkey, year(o_orderdate) || ',' || (year(o_orderdate) + 1) || ',' || year(o_orderdate) AS years FROM orders",
    "q_number_conflict": f"""
SELECT p_partkey::VARCHAR AS claim_id, {_CLASH} AS has_conflict, NULL::VARCHAR AS escalate_reason, CASE WHEN {_CLASH} THEN '$' || {_PRICE} END AS excerpt, CASE WHEN {_CLASH} THEN 21 END AS excerpt_start FROM part
""",
    "q_range_conflict": """
SELECT p_partkey::VARCHAR AS claim_id, p_partkey % 3 = 1 AS has_conflict, CASE WHEN p_partkey % 3 = 2 THEN 'range_overlap' END AS escalate_reason FROM part
""",
    "q_conflict_fast_exit": f"""
SELECT p_partkey::VARCHAR AS claim_id, 'CONTRADICTED' AS status, 'tier25_numerical' AS verification_method, 0.0::DOUBLE AS factual_consistency_score, 'part_' || p_partkey AS sources_used,
  'The retail price is ' || CASE WHEN p_partkey % 5 = 0 THEN 'approximately ' ELSE '' END || '$' || {_TOLD} || ' today.' AS offending_claim FROM part WHERE {_CLASH}
""",
    "q_response_text": """
WITH r AS (SELECT item_id AS i, to_json(text)::VARCHAR AS t, item_id % 11 = 10 AS junk, 's' || item_id % 5 AS s FROM benchmark),
j AS (SELECT i, junk, '{"textual_entailment":{"label":"' || CASE i % 3 WHEN 0 THEN 'Entailment' WHEN 1 THEN 'Contradiction' ELSE 'Neutral' END || '","probability":' || CASE WHEN i % 7 = 6 THEN '1.5' ELSE '0.5' END
  || '},"conceptual_coverage":{"percentage":50.0},"factual_consistency_score":75.0,"verifications":[{"claim_text":' || t || ',"status":"' || CASE i % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END
  || '","source_id":"' || s || '"' || CASE WHEN i % 4 = 3 THEN '' ELSE ',"source_excerpt":' || t END || CASE WHEN i % 8 = 3 THEN ',"reasoning_basis":["sum of two figures"]' ELSE '' END
  || '}],"source_attributions":[{"source_id":"' || s || '","role":"Supporting"},{"source_id":"s99","role":"Supporting"},{"source_id":"s1","role":"Not Used"}],"overall_verdict":"Verdict ' || i || '"}' AS json FROM r)
SELECT i AS item_id, CASE WHEN i % 5 = 3 THEN CASE WHEN i % 2 = 0 THEN '{"a": 1}' ELSE '' END WHEN i % 2 = 0 AND i % 5 = 2 THEN ''
  WHEN NOT junk THEN json WHEN i % 2 = 0 THEN 'no JSON here' ELSE CASE i % 5 WHEN 1 THEN '<think>so {x}</think>' WHEN 2 THEN '<think>' ELSE '' END || 'no JSON here' END AS json FROM j
""",
    "q_response_validate": f"WITH {_MODEL_ROW} SELECT item_id, error IS NULL AS valid, error FROM va",
    "q_llm_result": f"""
WITH {_MODEL_ROW}, ok AS (SELECT *, item_id % 2 = 1 AS inf, item_id % 5 AS sid FROM va WHERE error IS NULL), x AS (SELECT *, m = 0 AND bare AND NOT inf AS lost FROM ok)
SELECT item_id::VARCHAR AS claim_id, CASE WHEN lost THEN 'UNVERIFIABLE' WHEN m = 0 THEN 'VERIFIED' WHEN m = 1 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS status, m = 0 AND NOT lost AS is_valid,
  CASE WHEN lost THEN 0.0 ELSE 0.75 END::DOUBLE AS factual_consistency_score, 's' || sid AS sources_used, CASE WHEN m = 1 THEN t END AS offending_claim,
  CASE WHEN lost THEN 'UNVERIFIABLE' WHEN m = 0 THEN 'VERIFIED' WHEN m = 1 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS atom_status, CASE WHEN inf THEN 'Inferential' ELSE 'Extractive' END AS claim_type,
  CASE WHEN lost THEN 'no_citation' WHEN m = 2 THEN 'no_evidence' END AS unverifiable_reason, CASE WHEN sid = 1 THEN 'p. 4' END AS page_hint, CASE WHEN m = 0 AND NOT bare AND sid = 2 THEN 0.0 END::DOUBLE AS confidence FROM x
""",
    "q_analysis_aggregate": f"""
WITH {_STATUS}, a AS (SELECT analysis_id, count(*) AS total_units, count(*) FILTER (status = 'VERIFIED') AS grounded_units, count(*) FILTER (status = 'CONTRADICTED') AS ungrounded_units, count(*) FILTER (status = 'UNVERIFIABLE') AS unverifiable_units FROM st GROUP BY 1),
b AS (SELECT *, CASE WHEN total_units > unverifiable_units THEN grounded_units / (total_units - unverifiable_units) ELSE 0 END AS s FROM a),
c AS (SELECT *, CASE WHEN total_units = unverifiable_units THEN 'NOT_GROUNDED' WHEN s >= 0.8 THEN 'GROUNDED' WHEN s > 0 THEN 'PARTIALLY_GROUNDED' ELSE 'NOT_GROUNDED' END AS status FROM b)
SELECT analysis_id, total_units, grounded_units, ungrounded_units, unverifiable_units, round(s, 6) AS score, status, status = 'GROUNDED' AS is_grounded FROM c
""",
    "q_answer_faithfulness": f"WITH {_VERDICTS} SELECT answer_id, total, entailed, round(score, 6) AS score, status, status <> 'NOT_GROUNDED' AND score >= 0.8 AS is_grounded FROM fs",
    "q_majority_vote": """
WITH v AS (SELECT o_orderkey AS answer_id, vote, (o_orderkey * 7 + vote * (o_custkey % 5)) % 10 AS k FROM orders, range(0, 3) r(vote)),
c AS (SELECT answer_id, vote, k / 10 AS score, CASE WHEN k < 3 THEN 'NOT_GROUNDED' WHEN k / 10 >= 0.5 THEN 'GROUNDED' ELSE 'PARTIALLY_GROUNDED' END AS cast_ FROM v),
b AS (SELECT answer_id, cast_, count(*) AS n, arg_min(score, vote) AS first_score, min(vote) AS first_vote FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY n DESC, first_vote) AS o FROM b), l AS (SELECT answer_id, min(score) AS least FROM c GROUP BY 1),
f AS (SELECT answer_id, n = 1 AS tie_broken, CASE WHEN n = 1 THEN 'NOT_GROUNDED' ELSE cast_ END AS status, CASE WHEN n = 1 THEN least ELSE first_score END AS score FROM r JOIN l USING (answer_id) WHERE o = 1)
SELECT answer_id, status, round(score, 6) AS score, tie_broken, status <> 'NOT_GROUNDED' AND score >= 0.5 AS is_grounded FROM f
""",
    "q_accumulator": f"""
WITH {_VERDICTS} SELECT conv_id, round(CASE WHEN conv_id % 3 = 0 THEN avg(score) ELSE sum(entailed) / sum(total) END, 6) AS overall_score, bool_and(status <> 'NOT_GROUNDED' AND score >= 0.8) AS is_grounded, count(*) AS n_results FROM fs GROUP BY conv_id
""",
    "q_spend_cap": """
WITH s AS (SELECT o_orderkey AS input_ord, sum((o_orderkey % 7 + 1) / 8) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS spent FROM orders)
SELECT input_ord, round(spent, 6) AS spent, spent > 1.5 AS skipped, round(CASE WHEN spent > 1.5 THEN 0 ELSE spent END, 6) AS total_cost_usd FROM s
""",
    "q_cost_estimate": f"""
WITH c AS (SELECT conv_id, turn, 350 + 2 * {_tokens("text")} + {_tokens("'one two three'")} + {_tokens("'a b'")} AS i,
  CASE turn % 4 WHEN 0 THEN 0.00015 WHEN 1 THEN 0.0025 WHEN 2 THEN 0.003 ELSE 0 END AS pi, CASE turn % 4 WHEN 0 THEN 0.0006 WHEN 1 THEN 0.01 WHEN 2 THEN 0.015 ELSE 0 END AS po FROM conversations)
SELECT conv_id, turn, i AS input_tokens, 200::BIGINT AS output_tokens, round(3 * (i / 1000 * pi + 0.2 * po), 9)::DOUBLE AS total_usd FROM c
""",
    "q_analysis_cost": f"""
WITH c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS l FROM conversations),
d AS (SELECT conv_id, turn, greatest(len(l), 1) AS n, coalesce(list_sum(list_transform(l, lambda x: {_tokens("x").replace("lambda x: x <>", "lambda y: y <>")})), 0) AS own FROM c)
SELECT conv_id, turn, ((350 + {_tokens("'one two three'")}) * n + own)::BIGINT AS input_tokens, (200 * n)::BIGINT AS output_tokens,
  round(((350 + {_tokens("'one two three'")}) * n + own) / 1000 * 0.0035 + 200 * n / 1000 * 0.0105, 9)::DOUBLE AS total_usd FROM d
""",
    "q_resume_antijoin": "SELECT doc_id AS sample_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q_rag_metrics": f"""
WITH {_STATUS}, m AS (SELECT analysis_id AS sample_id, count(*) AS n_units, count(*) FILTER (status = 'CONTRADICTED') AS contradicted_count, count(*) FILTER (status = 'UNVERIFIABLE') AS unverifiable_count FROM st GROUP BY 1)
SELECT sample_id, n_units, contradicted_count, unverifiable_count, contradicted_count > 0 AS has_contradiction, round(unverifiable_count / n_units, 6) AS unverifiable_ratio, quality = 0 OR toxic = 1 AS hallucinated FROM m JOIN labels ON doc_id = sample_id
""",
    "q_verify_structured": "SELECT o_orderkey::VARCHAR AS claim_id, 'VERIFIED' AS status, 'tier3_llm' AS verification_method FROM orders",
    "q_evidence_bundle": r"""
WITH c AS (SELECT source AS corpus_id, doc_id::VARCHAR AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents
  WHERE regexp_matches(text, '(?i)(^|[^\pL\pN_])[+-]?(?:(?:[$€£¥₹₩₽]|(?:USD|EUR|GBP|JPY|CHF|CAD|AUD|HKD)\s*))?\d[\d,]*(?:\.\d+)?(?:e[+-]?\d+)?(?:\s*(?:%|[MBKT](?:illion)?|bps?|basis\s+points?))?($|[^\pL\pN_])'))
SELECT corpus_id, source_id, place FROM c WHERE place <= 3
""",
    "q_verify_cascade": f"""
SELECT p_partkey::VARCHAR AS claim_id, CASE WHEN {_CLASH} THEN 'CONTRADICTED' ELSE 'OPEN' END AS status, CASE WHEN {_CLASH} THEN 'tier25_numerical' ELSE 'skipped' END AS verification_method FROM part
""",
}
