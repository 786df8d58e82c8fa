"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network routes
each pattern's words to the quotas of its sources; the k-th copy of a pattern's words costs k - 1 a word, so
repetition is convex and used only where quotas need it. The flow gives each pattern so many words to take.
Documents then follow in the order of a seeded hash: their exact prefix sums (by bucket of the hash, then
within each bucket, so no key is summed in one task) turn a pattern's words into one hash cutoff for each copy.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import Scratch, batch_of, slices, slim

#: Patterns are aggregated before they reach the driver; more than this is an error, not a truncation.
MAX_PATTERNS = 100_000
_BUCKET_BITS = 12


def water_fill(sizes: list[int], weights: list[int], total: Fraction, times: int) -> list[Fraction]:
    """Shares of total by weight, none above times its size; the excess is shared again by weight."""
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(total), set(range(len(sizes)))
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > times * sizes[i]}
        for i in full or open_:
            out[i] = Fraction(times * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class MinCostFlow:
    """Successive shortest paths with integer capacities."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.arcs[a].append(_Arc(b, room, cost, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def flow(self, at: tuple[int, int]) -> int:
        arc = self.arcs[at[0]][at[1]]
        return self.arcs[arc.to][arc.back].room

    def run(self, start: int, end: int) -> None:
        n = len(self.arcs)
        while True:
            far, via, waits, queue = [None] * n, [None] * n, [False] * n, deque([start])
            far[start] = 0
            while queue:
                a = queue.popleft()
                waits[a] = False
                for k, arc in enumerate(self.arcs[a]):
                    if arc.room and (far[arc.to] is None or far[a] + arc.cost < far[arc.to]):
                        far[arc.to], via[arc.to] = far[a] + arc.cost, (a, k)
                        if not waits[arc.to]:
                            waits[arc.to] = True
                            queue.append(arc.to)
            if far[end] is None:
                return
            path, b = [], end
            while b != start:
                path.append(via[b])
                b = via[b][0]
            most = min(self.arcs[a][k].room for a, k in path)
            for a, k in path:
                arc = self.arcs[a][k]
                arc.room -= most
                self.arcs[arc.to][arc.back].room += most


def route(patterns: list[tuple[tuple, int]], quotas: dict, times: int) -> list[list[tuple[object, int]]]:
    """For each (sources, words) pattern the words that go to each of its sources."""
    names = list(quotas)
    place = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    net = MinCostFlow(2 + len(patterns) + len(names))
    ways = []
    for i, (sources, words) in enumerate(patterns):
        for copy in range(times):
            net.add(0, 2 + i, words, copy)
        ways.append([(s, net.add(2 + i, place[s], times * words, 0)) for s in sources])
    for s in names:
        net.add(place[s], 1, quotas[s], 0)
    net.run(0, 1)
    return [[(s, net.flow(at)) for s, at in way] for way in ways]


def _weights(n: int, cycle: tuple[int, ...]) -> list[int]:
    return [cycle[i % len(cycle)] for i in range(n)]


def _sized(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep and __size, the text's words (runs without ASCII white space; null: 0)."""
    rows = docs.select(*keep, text) if text not in keep else docs.select(*keep)
    out = docs.select(*keep).schema.add("__size", "long")

    def run(batches):
        for batch, texts in slices(batches, text):
            own = [batch.column(n) for n in keep]
            fields = [pa.field(n, c.type) for n, c in zip(keep, own, strict=True)] + [pa.field("__size", pa.int64())]
            yield batch_of(pa.schema(fields), *own, [len(x.split()) for x in texts])

    return rows.mapInArrow(slim(run), out)


@dataclass(frozen=True)
class Mix:
    """plan: a row for each pattern (sources, source_size, target, flow, cut array); rows: the sized documents."""

    plan: DataFrame
    rows: DataFrame
    scratch: Scratch


def _pattern(docs: DataFrame, source: str):
    """The sorted set of a document's sources as JSON text."""
    array = isinstance(docs.schema[source].dataType, T.ArrayType)
    member = F.array_sort(F.array_distinct(F.col(source))) if array else F.array(F.col(source))
    some = F.size(F.coalesce(member, F.array().cast("array<string>"))) > 0
    return F.to_json(F.when(some, member).otherwise(F.array(F.lit(None).cast("string"))))


def order_of(seed: int, *columns: str):
    return F.xxhash64(F.lit(seed), *columns)


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", cycle: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), times: int = 2, seed: int = 17) -> Mix:
    """Sizes documents, solves the flow and finds the hash cutoffs.

    source is a string or an array of strings; null is a source of its own, an array's repeats count once and an
    empty array is null. Sources in the order of their code points (null last) have the weights of cycle in turn.
    Null and empty texts have size 0 and are never taken. Rows that agree in key and text share a hash and so a
    decision. An empty table gives an empty plan. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    ready = docs.select(F.col(key).alias("__key"), _pattern(docs, source).alias("__pattern"), order_of(seed, key, text).alias("__order"), F.col(text).alias("__text"))
    rows = scratch.keep(_sized(ready, "__text", ["__key", "__pattern", "__order"]), "rows")
    sums = rows.groupBy("__pattern").agg(F.sum("__size").alias("n"))
    found = sums.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted(((tuple(json.loads(r["__pattern"])), r["n"] or 0, r["__pattern"]) for r in found), key=lambda p: p[2])
    sizes: dict = {}
    for sources, n, _ in patterns:
        for s in sources:
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = share * sum(n for _, n, _ in patterns)
    targets = dict(zip(names, water_fill([sizes[s] for s in names], _weights(len(names), cycle), total, times), strict=True))
    flows = route([(p, n) for p, n, _ in patterns], {s: round(t) for s, t in targets.items()}, times)
    table = [(text_, sizes[p[0]], float(targets[p[0]]), n, sum(f for _, f in way), [(s, f) for s, f in way if f]) for (p, n, text_), way in zip(patterns, flows, strict=True)]
    plan = spark.createDataFrame(table, "__pattern string, source_size long, target double, __words long, __flow long, __routes array<struct<source:string,words:long>>")
    by_bucket = Window.partitionBy("__pattern").orderBy("__bucket")
    within = Window.partitionBy("__pattern", "__bucket").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__bucket", F.shiftright("__order", 64 - _BUCKET_BITS))
    starts = placed.groupBy("__pattern", "__bucket").agg(F.sum("__size").alias("n")).select("__pattern", "__bucket", (F.sum("n").over(by_bucket) - F.col("n")).alias("__start"))
    exact = placed.withColumn("__before", F.coalesce(F.sum("__size").over(within), F.lit(0))).join(starts, ["__pattern", "__bucket"]).join(F.broadcast(plan.select("__pattern", "__words", "__flow")), "__pattern")
    middle = F.col("__start") + F.col("__before") + F.col("__size") / 2
    cuts = exact.groupBy("__pattern").agg(*[F.min(F.when(middle + F.col("__words") * copy > F.col("__flow"), F.col("__order"))).alias(f"__cut{copy}") for copy in range(times)])
    cuts = scratch.keep(cuts, "cuts")
    return Mix(plan.join(F.broadcast(cuts), "__pattern", "left"), rows, scratch)


def copies_of(order, times: int):
    """How often a row is taken: once for each copy whose cutoff its hash stays below."""
    taken = F.lit(0)
    for copy in range(times):
        cut = F.col(f"__cut{copy}")
        taken = taken + F.when(cut.isNull() | (order < cut), 1).otherwise(0)
    return taken


def mix_report(docs: DataFrame, times: int = 2, **how) -> DataFrame:
    """Per document: doc_id, size, source_size and target (of its first source), taken, copies."""
    mix = plan_mix(docs, times=times, **how)
    rows = mix.rows.join(F.broadcast(mix.plan), "__pattern")
    copies = F.when(F.col("__size") > 0, copies_of(F.col("__order"), times)).otherwise(0)
    out = rows.select(F.col("__key").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (copies * F.col("__size")).alias("taken"), copies.alias("copies"))
    return mix.scratch.last(out)


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", times: int = 2, seed: int = 17, **how) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it. Texts are not shuffled.

    Nulls, ties, repeated rows and empty tables are as in plan_mix: rows without a word go, rows equal in key and
    text are taken alike. Other columns pass through; names that begin with two underscores are refused.
    """
    if odd := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns {odd} clash with those of the mix")
    mix = plan_mix(docs, text=text, source=source, key=key, times=times, seed=seed, **how)
    has_word = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.withColumns({"__pattern": _pattern(docs, source), "__order": order_of(seed, key, text)}).join(F.broadcast(mix.plan.select("__pattern", *[f"__cut{c}" for c in range(times)])), "__pattern")
    taken = marked.withColumn("__taken", F.when(has_word, copies_of(F.col("__order"), times)).otherwise(0)).where("__taken > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__taken")))).select(*docs.columns)
