"""URL filters: pattern rules indexed by their rarest literal token.

A rule is written as in host lists and ad blockers: `|` anchors at the start or end of the URL, `||` at the
start of the host or after one of its dots, `*` stands for anything, `^` for one separator or the end; all
else is literal. Every run of [a-z0-9] in a rule that cannot be part of a longer run in a matching URL is one
of its tokens; a rule without any has the ends, beginnings or, failing those, insides of URL tokens that its runs
must be. How often each of those occurs is counted over the whole URL column (the counts are bounded by the
rules, not by the data). The index holds each rule under its rarest one only; a URL's tokens, and their parts of
the indexed lengths, fetch candidate rules, and only these run their regular expressions. Only a rule without a
letter or digit runs on every URL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import batch_of

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules travel to every task as one broadcast; beyond this many bytes build one filter for each part of the list.
MAX_RULE_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """pattern as above; name is what a match reports; of several matches the highest rank wins, then block."""

    pattern: str
    action: str
    name: str | None = None
    rank: int = 0


def host_rule(host: str, path: str, action: str) -> Rule:
    """Fits the host, its subdomains, and paths that start with path; the longest such rule wins."""
    return Rule(f"||{host}{path}", action, f"{host}{path}", len(host) + len(path))


#: Host names and path words of gambling, pharmacy, advertising and spam pages.
DEFAULT_RULES = (
    Rule("spam-farm", "block"),
    Rule("casino-win", "block"),
    Rule("ads-track", "block"),
    Rule("free-bets", "block"),
    Rule("||ads.", "block"),
    Rule("||adserver.", "block"),
    Rule("^casino^", "block"),
    Rule("^poker^", "block"),
    Rule("^viagra^", "block"),
    Rule("^porn^", "block"),
    Rule("^xxx^", "block"),
    Rule("/doubleclick/", "block"),
    Rule("cheap-pills", "block"),
)


def compiled(rule: Rule) -> str:
    """The rule's regular expression; one that begins with `||` is for the part of the URL from its host on."""
    body, head = rule.pattern, ""
    if body.startswith("||"):
        body, head = body[2:], r"^(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    end = body.endswith("|")
    body = body[:-1] if end else body
    parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
    return head + "".join(parts.get(c) or re.escape(c) for c in body) + ("$" if end else "")


def tokens_of(rule: Rule) -> list[str]:
    """Tokens that every matching URL has, letters lower-cased; `*` marks where a URL's token may go on.

    Whole tokens where the rule has some, else ends (`*spam`) and beginnings (`farm*`) of tokens, else parts (`*bet*`).
    """
    body = rule.pattern.lower()
    start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
    body = body[len(start) :]
    found = defaultdict(list)
    for m in TOKEN.finditer(body):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and bool(start)
        right = m.end() < len(body) and body[m.end()] != "*"
        found[left + right].append(("" if left else "*") + m[0] + ("" if right else "*"))
    return found[max(found)] if found else []


def shapes_of(tokens: Iterable[str]) -> list[tuple[bool, bool, int]]:
    """Whether a token may go on before and after, and the length, of those tokens that are not whole."""
    return sorted({(t[0] == "*", t[-1] == "*", len(t.strip("*"))) for t in tokens if "*" in t})


def parts_of(token: str, shapes: list[tuple[bool, bool, int]]) -> Iterator[str]:
    """The parts of a URL's token that have one of the shapes, marked as in tokens_of."""
    for before, after, n in shapes:
        last = len(token) - n
        if last >= 0:
            starts = range(last + 1) if before and after else [last if before else 0]
            yield from (f"{'*' * before}{token[i : i + n]}{'*' * after}" for i in starts)


def _parts_column(words: Column, before: bool, after: bool, n: int) -> Column:
    """parts_of all words for one shape."""
    long_ = F.filter(words, lambda t: F.length(t) >= n)
    cut = lambda t, i: F.concat(F.lit("*" * before), t.substr(i, F.lit(n)), F.lit("*" * after))
    if before and after:
        return F.flatten(F.transform(long_, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: cut(t, i))))
    return F.transform(long_, lambda t: cut(t, F.length(t) - n + 1 if before else F.lit(1)))


def token_counts(urls: DataFrame, url: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """URLs that hold each token of the rules; at most one row for each token of the rules reaches the driver."""
    wanted = sorted({t for r in rules for t in tokens_of(r)})
    if not wanted:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit("([a-z0-9]+)"), 1))
    parts = F.concat(F.col("words"), *[_parts_column(F.col("words"), *shape) for shape in shapes_of(wanted)])
    held = urls.select(words.alias("words")).select(F.array_distinct(F.filter(parts, lambda t: t.isin(wanted))).alias("held"))
    hits = held.select(F.explode("held").alias("token"))
    return {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers under each rule's rarest token (ties: the longer, then the smaller), and those without any."""
    index, rest = defaultdict(list), []
    for i, rule in enumerate(rules):
        if tokens := tokens_of(rule):
            index[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(i)
        else:
            rest.append(i)
    return dict(index), rest


_PARTS = re.compile(r"^(.*?://)([^/?#]*)([^?#]*)", re.S)
_UPPER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str, str, str]:
    """Host (A-Z lower-cased), path, and what rules see: the URL and its part from the host on.

    All are empty for null or without ://.
    """
    m = _PARTS.match(url or "")
    if not m:
        return "", "", "", ""
    host = m[2].translate(_UPPER)
    rest = host + url[m.end(2) :]
    return host, m[3], m[1].translate(_UPPER) + rest, rest


class Matcher:
    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.rules, self.tried = rules, 0
        self.index, self.rest = build_index(rules, counts)
        self.shapes = shapes_of(self.index)
        self.found = [re.compile(compiled(r), re.S) for r in rules]

    def best(self, seen: str, rest: str) -> Rule | None:
        """The winning rule for what split_url gives; only candidates of the URL's tokens are tried."""
        tokens = set(TOKEN.findall(seen.translate(_UPPER)))
        tokens.update([p for t in tokens for p in parts_of(t, self.shapes)])
        candidates = {i for t in tokens for i in self.index.get(t, ())}
        candidates.update(self.rest)
        self.tried += len(candidates)
        hits = [self.rules[i] for i in candidates if self.found[i].search(rest if self.rules[i].pattern.startswith("||") else seen)]
        return max(hits, key=lambda r: (r.rank, r.action == "block", r.pattern), default=None)


def url_verdicts(urls: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Per row: the columns in keep, host, path, rule (the winner's name) and verdict.

    Narrow: no shuffle besides the small token counts. Null URLs and URLs without `://` have empty host and path,
    match no rule and get the default verdict. Rows are independent, so ties and repeated rows keep their own
    results; an empty table gives an empty one; columns besides keep and url are not read.
    """
    if (size := sum(len(r.pattern) + len(r.name or "") for r in rules)) > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules; at most {MAX_RULE_BYTES} are broadcast")
    spark = urls.sparkSession
    told = spark.sparkContext.broadcast((rules, token_counts(urls, url, rules)))
    rows = urls.select(*keep, F.col(url).alias("__url"))
    out = rows.select(*keep).schema
    for name in ("host", "path", "rule", "verdict"):
        out = out.add(name, "string")

    def run(batches):
        matcher = Matcher(*told.value)
        for batch in batches:
            got = [[], [], [], []]
            for u in batch.column("__url").to_pylist():
                host, path, seen, rest = split_url(u)
                hit = matcher.best(seen, rest) if seen else None
                for x, v in zip(got, (host, path, hit.name if hit else None, hit.action if hit else default), strict=True):
                    x.append(v)
            own = [batch.column(n) for n in keep]
            fields = [pa.field(n, c.type) for n, c in zip(keep, own, strict=True)] + [pa.field(n, pa.string()) for n in ("host", "path", "rule", "verdict")]
            yield batch_of(pa.schema(fields), *own, *got)

    return rows.mapInArrow(run, out)
