"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.shared import tables


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its repeated 200-byte strings."""
    from plumbline.llm.substring_dedup import dedup_report

    return dedup_report(tables(sf_dir, spark, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a suffix tree learned from nine tenths of the documents."""
    from plumbline.llm.suffix_tree import score_report

    return score_report(tables(sf_dir, spark, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by rules whose cutoffs the labelled documents of its language allow."""
    from plumbline.llm.quality import quality_report

    return quality_report(tables(sf_dir, spark, "documents"), tables(sf_dir, spark, "labels"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's."""
    from plumbline.llm.fingerprint import fingerprint_report

    return fingerprint_report(tables(sf_dir, spark, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    from plumbline.llm.simhash import near_duplicates

    return near_duplicates(tables(sf_dir, spark, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by five host and path rules, else by the default pattern rules."""
    from plumbline.llm.url_filter import DEFAULT_RULES, url_verdicts

    return url_verdicts(tables(sf_dir, spark, "pages"), HOST_RULES() + DEFAULT_RULES)


def HOST_RULES():  # noqa: N802
    from plumbline.llm.url_filter import host_rule

    return (
        host_rule("com", "/en/", "block"),
        host_rule("example.com", "/en/7", "allow"),
        host_rule("net", "/de/", "allow"),
        host_rule("example.net", "/de/8", "block"),
        host_rule("org", "/es/", "block"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    import public_tokenizers

    from plumbline.llm.bpe import bpe_tokens

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe_tokens(tables(sf_dir, spark, "documents"), ranks, public_tokenizers.PATTERN, ids=False)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the labelled documents."""
    from pyspark.sql import functions as F

    from plumbline.llm.language import label_languages, train

    docs = tables(sf_dir, spark, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    got = label_languages(docs.withColumn("held_out", held_out), train(docs), keep=["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: 150% of all words, weights 3, 1, 2 in turn, at most two copies of each."""
    from plumbline.llm.mixing import mix_report

    return mix_report(tables(sf_dir, spark, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives, then read back from them."""
    from plumbline.llm.shared import Scratch
    from plumbline.llm.warc import read_warc, write_warc

    back = read_warc(write_warc(tables(sf_dir, spark, "pages"), Scratch(spark, "warc")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_quality": op3_quality,
    "op4_fingerprint": op4_fingerprint,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
}

_OP6 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages
), v AS (
  SELECT page_id, CASE WHEN pos = 0 THEN '' ELSE url END AS url,
         CASE WHEN pos = 0 THEN '' ELSE substr(url, pos + 3) END AS rest FROM u
), w AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest, url FROM v
), x AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path,
         substr(url, 1, length(url) - length(rest)) AS scheme, substr(rest, length(raw_host) + 1) AS tail FROM w
), y AS (
  SELECT page_id, host, path, host || tail AS rest, scheme || host || tail AS seen,
    CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
         WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
         WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM x
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(seen, 'spam-farm|casino-win|ads-track|free-bets|/doubleclick/|cheap-pills|[^A-Za-z0-9_.%-](casino|poker|viagra|porn|xxx)([^A-Za-z0-9_.%-]|$)')
         OR regexp_matches(rest, '^([^/?#]*\.)?(ads|adserver)\.') THEN 'block' ELSE 'allow' END AS verdict
FROM y
"""

_OP10 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (SELECT d, n, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""

_OP1 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM e),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT r, i FROM w SEMI JOIN t USING (m)),
g AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 200, -1) AS fresh FROM s),
k AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
x AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY r, run),
y AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM x),
z AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN z USING (r)
"""

ORACLE = {"op1_suffix_dedup": _OP1, "op6_url_filter": _OP6, "op10_warc": _OP10}
