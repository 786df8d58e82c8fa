"""Column functions over text, chunking, fuzzy matching and costs."""

import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.evaluators import responses
from plumbline.evaluators.protocol import BACKOFF_TRIES, TransientError, request, with_backoff
from plumbline.functions import text as tx
from plumbline.model import Config
from plumbline.operators.chunking import chunk_sources, windows
from plumbline.operators.fuzzy import evidence_gate, indel_ratio, partial_ratio

import pytest


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_atoms(spark):
    got = values(spark, tx.atoms, ["Revenue was $4.2M.", "Q1 was $4.2M. Q2 was $5.1M.", "Line one.\nLine two.", ". ", "It rose in 2023. Next", "Préc. Été "])
    assert got == [["Revenue was $4.2M."], ["Q1 was $4.2M", "Q2 was $5.1M."], ["Line one", "Line two."], [], ["It rose in 2023. Next"], ["Préc", "Été"]]


def test_claim_type(spark):
    assert values(spark, tx.claim_type, ["The trend is up", "trendy", "Sales are Expected To grow", None]) == ["Inferential", "Extractive", "Inferential", "Extractive"]


def test_think_and_fences(spark):
    assert values(spark, tx.strip_think, ["<think>a</think> {1}", "<think>open", "x</thinking>y", "plain ", "a</think>b</think> c"]) == ["{1}", "", "y", "plain", "c"]
    assert values(spark, tx.strip_fences, ['t ```json\n{"a": 1}\n``` u', "```\nnot json\n```", " [1] "]) == ['{"a": 1}', "```\nnot json\n```", "[1]"]
    assert values(spark, tx.json_substring, ['x {"a": [1]} y', "n [1, 2] z", "none ", "} {"]) == ['{"a": [1]}', "[1, 2]", "none", "} {"]


def test_flattened(spark):
    df = spark.sql("SELECT named_struct('company', named_struct('q3', named_struct('revenue', '5M')), 'items', array(named_struct('name', 'A'), named_struct('name', 'B')), 'ok', true, 'no', cast(null as string)) AS r")
    out = df.select(tx.flattened(F.col("r"), df.schema["r"].dataType)).head()[0]
    assert out == "company.q3.revenue: 5M\nitems[0].name: A\nitems[1].name: B\nok: True\nno: None"


@given(st.lists(st.sampled_from(["a", "bb", "ccc", " ", "\n", " "]), max_size=80), st.integers(2, 9), st.data())
def test_windows_cover(parts, size, data):
    text = "".join(parts)
    overlap = data.draw(st.integers(0, size - 1))
    got = list(windows(text, size, overlap))
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if not spans:
        assert got == [(0, len(text))]
        return
    assert {w for w in spans for a, b in got if a <= w[0] and w[1] <= b} == set(spans)
    assert all(len(text[a:b].split()) <= size for a, b in got)
    assert got[-1][1] == spans[-1][1]


def test_chunk_offsets(spark):
    texts = ["word " * 50, "short", "", "  "]
    src = spark.createDataFrame([("c", i, f"s{i}", t) for i, t in enumerate(texts)], "corpus_id string, source_ord long, source_id string, content string")
    rows = chunk_sources(src, Config(chunk_size=20, chunk_overlap=5, max_source_tokens=10)).collect()
    assert len(rows) > 4
    assert all(texts[r.source_ord][r.char_start : r.char_end] == r.text_content for r in rows)
    with pytest.raises(ValueError):
        Config(chunk_size=5, chunk_overlap=5)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_indel_ratio(a, b):
    want = 100.0 if not a and not b else 200 * slow_lcs(a, b) / (len(a) + len(b))
    assert abs(indel_ratio(a, b) - want) < 1e-9
    assert 0 <= partial_ratio(a, b) <= 100


def test_evidence_gate(spark):
    claims = spark.createDataFrame([("1", "c", "revenue rose"), ("2", "c", "qqq zzz"), ("3", "c", ""), ("4", "x", "any"), ("5", "c", None)], "claim_id string, corpus_id string, evidence string")
    chunks = spark.createDataFrame([("c", i, f"s{i}", 0, t, 0, len(t)) for i, t in enumerate(["nothing here", "our revenue", "revenue again"])], "corpus_id string, source_ord long, source_id string, chunk_ord int, text_content string, char_start int, char_end int")
    got = {r.claim_id: (r.source_id, r.passed) for r in evidence_gate(claims, chunks).collect()}
    assert got["1"] == ("s1", True)
    assert not got["2"][1] and not got["3"][1] and got["4"] == (None, False) and "5" not in got


def test_reason_text_becomes_a_list(spark):
    json = '{"textual_entailment":{"label":"Entailment","probability":1},"conceptual_coverage":{"percentage":1},"factual_consistency_score":100,"verifications":[{"claim_text":"a","status":"VERIFIED","reasoning_basis":"one \\"step\\""}],"source_attributions":[],"overall_verdict":"v"}'
    df = responses.validated(spark.createDataFrame([(json,), (json.replace('"probability":1', '"probability":2'),), ("{",)], "content string"))
    assert [(r.valid, r.error) for r in df.collect()] == [(True, None), (False, "probability"), (False, "incomplete")]


def test_backoff():
    pauses, calls = [], []

    def call():
        calls.append(1)
        raise TransientError("x")

    with pytest.raises(TransientError):
        with_backoff(call, pauses.append)
    assert len(calls) == BACKOFF_TRIES and pauses == [1, 2, 4, 8]


def test_requests():
    assert request("ollama/x", [])["model"] == "ollama_chat/x"
    assert "temperature" not in request("o3", [])
    assert request("nvidia_nim/microsoft/phi-4-mini-instruct", [])["response_format"] == {"type": "json_object"}
    assert request("nvidia_nim/nvidia/nemotron-3-nano", [])["extra_body"]["reasoning_budget"] == 16384
