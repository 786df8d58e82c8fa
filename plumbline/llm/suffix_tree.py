"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is lower-cased (A-Z) and its words, runs without ASCII white space, are joined by one space and closed
by an end mark. The tree's contexts are the last few bytes, at most DEPTH of them. All contexts of the training
texts are counted; one is retained if the evidence that its next bytes differ from those of the context one byte
shorter (its count times the Kullback-Leibler divergence) is above EVIDENCE for each different next byte. That does
not depend on the size of the corpus, so the tree grows with it. Distributions are smoothed by mixing in the
shorter context's (Witten-Bell) down to a uniform one, and scores follow the longest retained suffix.

A gram is a context of DEPTH bytes with the next byte. Every gram that occurs in any text, learned from or not, is a
row of one table with its training count, so each has its probability there. All contexts with the same last bytes
are in one task, which walks down their part of the tree: counts of a context are sums of longer ones'. The most
frequent grams, a fixed number, reach every scoring task; the others come by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import Scratch, batch_of, slices

#: Bytes of context (with the next byte they are at most a 64-bit number); nats for each different next byte.
DEPTH, EVIDENCE = 6, 3.0
#: Contexts of so many bytes have tables of their own; longer ones are walked in tasks by their last SHORT + 1 bytes.
SHORT = 3
#: The end mark, also the padding before a text; no word contains it.
END = 0x0A
#: So many of the most frequent words reach every task; counts of rarer ones come by a join.
HEAD_WORDS = 1 << 17
#: So many of the most frequent grams reach every task (12 bytes each); others come by a join.
HEAD_GRAMS = 1 << 21
#: Different grams that a counting task holds before it passes them on; bytes of text looked up, rows walked at once.
_HELD, _LOOKED_UP, _WALKED = 1 << 21, 2 << 20, 1 << 19


def token_line(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.lower().split()
    return words, b" ".join(words)


def _sequence(lines: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The padded, closed lines as one array, and which of its bytes count."""
    pad, end = bytes([END]) * depth, bytes([END])
    data = np.frombuffer(b"".join(pad + x + end for x in lines), np.uint8)
    counts = np.ones(len(data), bool)
    sizes = np.array([len(x) + 1 + depth for x in lines], np.int64)
    starts = np.cumsum(sizes) - sizes
    for k in range(depth):
        counts[starts + k] = False
    return data, counts


def grams_of(lines: list[bytes], depth: int) -> np.ndarray:
    """The context of depth bytes and the next byte, packed in a number, for each counted byte."""
    data, counts = _sequence(lines, depth)
    size = len(data) - depth
    # eight bytes from each place on, the first one highest
    ahead = np.ndarray((size,), ">u8", np.append(data, np.zeros(7 - depth, np.uint8)), strides=(1,))
    return ahead[counts[depth:]].astype(np.uint64) >> np.uint64(8 * (7 - depth))


def added(keys: np.ndarray, sums: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and their sums, with one more for each of the keys in more."""
    own = np.concatenate(more)
    own.sort()
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    keys = np.concatenate([keys, own[new]])
    sums = np.concatenate([sums, np.diff(np.append(new, len(own)))])
    by = np.argsort(keys, kind="stable")
    keys, sums = keys[by], sums[by]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(sums, new)


def deeper(codes: np.ndarray, n: np.ndarray, q: np.ndarray, p: np.ndarray, least: float, root: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level of the tree: shares, probabilities and whether the context is retained, for each row.

    codes: context and next byte; n: training counts; q, p: the byte's share and probability after the context one
    byte shorter. Rows of a context must all be there. The root is always retained.
    """
    kinds_of, first, back = np.unique(codes, return_index=True, return_inverse=True)
    own = np.bincount(back, n, len(kinds_of))
    context = kinds_of >> np.uint64(8)
    new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    at = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(context))))
    total, kinds = np.add.reduceat(own, new), np.add.reduceat((own > 0).astype(np.int64), new)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.add.reduceat(np.where(own > 0, own * np.log(own / q[first]), 0), new) - np.where(total > 0, total * np.log(total), 0)
        kept = (root | (gain > least * kinds)) & (total > 0)
        mixed = (own + kinds[at] * p[first]) / (total + kinds)[at]
        share = np.where(total[at] > 0, own / total[at], 0)
    return share[back], np.where(kept[at], mixed, p[first])[back], kept[at][back]


def _bytes(codes: np.ndarray, count: int) -> np.ndarray:
    """The last count bytes of numbers."""
    return codes & np.uint64((1 << (8 * count)) - 1)


def score_grams(lines: list[bytes], keys: np.ndarray, logp: np.ndarray, depth: int) -> tuple[np.ndarray, pa.ListArray]:
    """Sums of the log10 probabilities of each line's grams that are in the sorted keys, and its other grams with their times.

    A gram leaves some bits free for its line's number: so many lines at once are sorted as plain numbers, each gram
    of a line is looked up once, in order, which reads the keys once instead of at random.
    """
    bits = min(64 - 8 * (depth + 1), 16)
    scores, owners, odds, counts = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start in range(0, len(lines), 1 << bits):
        own = lines[start : start + (1 << bits)]
        grams = grams_of(own, depth) << np.uint64(bits)
        grams |= np.repeat(np.arange(len(own), dtype=np.uint64), [len(x) + 1 for x in own])
        grams.sort()
        new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        times = np.diff(np.append(new, len(grams)))
        line = (grams[new] & np.uint64((1 << bits) - 1)).astype(np.int64)
        gram, told, hit = grams[new] >> np.uint64(bits), np.zeros(len(new)), np.zeros(len(new), bool)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = keys[at] == gram
            told = np.where(hit, times * logp[at], 0)
        scores.append(np.bincount(line, told, len(own)))
        rest = np.flatnonzero(~hit)
        rest = rest[np.argsort(line[rest].astype(np.uint16), kind="stable")]
        owners.append(start + line[rest])
        odds.append(gram[rest])
        counts.append(times[rest])
    odd, times, owner = np.concatenate(odds), np.concatenate(counts).astype(np.int32), np.concatenate(owners)
    pairs = pa.StructArray.from_arrays([pa.array(odd.view(np.int64)), pa.array(times)], ["gram", "times"])
    offsets = np.searchsorted(owner, np.arange(len(lines) + 1)).astype(np.int32)
    return np.concatenate(scores), pa.ListArray.from_arrays(pa.array(offsets), pairs)


def learning(key: str = "doc_id"):
    """False for the held-out tenth: crc32 of the key as text modulo 10 is 0. Null keys are not learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10)) != 0, F.lit(False))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: the words of whole texts."""

    def run(batches):
        from collections import Counter

        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

        def out(words) -> Iterator[pa.RecordBatch]:
            items = list(words.items())
            for i in range(0, len(items), 1 << 16):
                part = items[i : i + (1 << 16)]
                yield batch_of(schema, [w for w, _ in part], [n for _, n in part])

        words = Counter()
        for _, texts in slices(batches, text):
            for t in texts:
                words.update(t.lower().split())
            if len(words) > _HELD // 4:
                yield from out(words)
                words.clear()
        yield from out(words)

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_grams(docs: DataFrame, learned, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """gram, n, m of whole texts: n counts it where learned (a boolean expression) holds, m everywhere.

    A task sends each of those it holds once.
    """

    def run(batches):
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = {True: none, False: none}

        def out() -> Iterator[pa.RecordBatch]:
            for learn, (keys, sums) in held.items():
                for i in range(0, len(keys), 1 << 17):
                    m = sums[i : i + (1 << 17)]
                    yield batch_of(schema, pa.array(keys[i : i + (1 << 17)].view(np.int64)), pa.array(m if learn else np.zeros_like(m)), pa.array(m))
                held[learn] = none

        more, size = {True: [], False: []}, 0

        def take() -> None:
            for learn, parts in more.items():
                if parts:
                    held[learn] = added(*held[learn], parts)
                    parts.clear()

        for batch, texts in slices(batches, "__text", _LOOKED_UP):
            learn = batch.column("learn").to_pylist()
            for kind in (True, False):
                if lines := [token_line(t)[1] for t, x in zip(texts, learn, strict=True) if x == kind]:
                    more[kind].append(grams_of(lines, depth))
                    size += len(more[kind][-1])
            if size >= _HELD:
                take()
                size = 0
            if max(len(keys) for keys, _ in held.values()) >= _HELD:
                yield from out()
        take()
        yield from out()

    rows = docs.select(F.col(text).alias("__text"), learned.alias("learn"))
    return rows.mapInArrow(run, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _last(code: str, count: int):
    return F.col(code).bitwiseAND((1 << (8 * count)) - 1)


def _whole_groups(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[list[np.ndarray]]:
    """Columns (the first a code) of rows sorted by group, the bytes of its context that stay together, cut between groups."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= _WALKED:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            part = _bytes(columns[0].view(np.uint64) >> np.uint64(8), group)
            cut = int(np.argmax(part == part[-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held, size = [[c[cut:] for c in columns]], len(part) - cut
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def grow(grams: DataFrame, scratch: Scratch, depth: int = DEPTH, least: float = EVIDENCE) -> DataFrame:
    """gram, m, logp (log10 of the byte's probability after the longest retained suffix) and order (that suffix's length).

    grams: gram, n, m. Bytes after one byte of context are at most 2 ** 16 and known everywhere.
    """
    if depth <= SHORT:
        raise ValueError(f"depth must be above {SHORT}")
    short = scratch.keep(grams.groupBy(_last("gram", SHORT + 1).alias("code")).agg(F.sum("n").alias("n")), "short")
    pairs = short.groupBy(_last("code", 2).alias("code")).agg(F.sum("n").alias("n")).collect()
    codes, n = np.array([r["code"] for r in pairs], np.uint64), np.array([r["n"] for r in pairs], np.int64)
    dense = [np.zeros(1 << 16) for _ in range(3)]
    if len(codes):
        q, p, _ = deeper(_bytes(codes, 1), n, np.full(len(n), 1 / 256), np.full(len(n), 1 / 256), least, root=True)
        q, p, kept = deeper(codes, n, q, p, least)
        for column, values in zip(dense, (q, p, kept), strict=True):
            column[codes.astype(np.int64)] = values
    told = grams.sparkSession.sparkContext.broadcast(dense)

    def walk(lengths: range, group: int, columns: list[str]):
        """Adds share, probability and order at the last of lengths; up to that of the first less one they come with the rows."""

        def run(batches):
            for got in _whole_groups(batches, group):
                codes, n = got[0].view(np.uint64), got[1]
                if len(got) > len(columns):
                    q, p, order = got[-3:]
                else:
                    q, p, order = (x[_bytes(codes, 2).astype(np.int64)] for x in told.value)
                for length in lengths:
                    q, p, kept = deeper(_bytes(codes, length + 1), n, q, p, least)
                    order = np.where(kept, length, order)
                for i in range(0, len(codes), 1 << 16):
                    cut = slice(i, i + (1 << 16))
                    fields = [(c, pa.int64()) for c in columns] + [("q", pa.float64()), ("p", pa.float64()), ("order", pa.int64())]
                    yield batch_of(pa.schema(fields), *[pa.array(c[cut]) for c in got[: len(columns)]], pa.array(q[cut]), pa.array(p[cut]), pa.array(order[cut].astype(np.int64)))

        return run

    tail = "q double, p double, order long"
    up = None
    for length in range(2, SHORT + 1):
        rows = short.groupBy(_last("code", length + 1).alias("code")).agg(F.sum("n").alias("n"))
        if up is not None:
            rows = rows.join(up, _last("code", length) == F.col("up")).select("code", "n", "q", "p", "order")
        context = F.shiftright("code", 8)
        rows = rows.repartition(context).sortWithinPartitions(context)
        up = scratch.keep(rows.mapInArrow(walk(range(length, length + 1), length, ["code", "n"]), f"code long, n long, {tail}").select(F.col("code").alias("up"), "q", "p", "order"), f"short{length}")
    rows = grams.join(up, _last("gram", SHORT + 1) == F.col("up")).select("gram", "n", "m", "q", "p", "order")
    context = _last("gram", SHORT + 2) - F.col("gram").bitwiseAND(255)
    rows = rows.repartition(context).sortWithinPartitions(context)
    done = rows.mapInArrow(walk(range(SHORT + 1, depth + 1), SHORT + 1, ["gram", "n", "m"]), f"gram long, n long, m long, {tail}")
    return done.select("gram", "m", F.log10("p").cast("float").alias("logp"), F.col("order").cast("int").alias("order"))


def gathered(table: DataFrame) -> list[list[bytes]]:
    """A table's columns on the driver, packed: binary ones joined by line feeds, numbers as in memory."""

    def run(batches):
        for batch in batches:
            packed = [b"\n".join(c.to_pylist()) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False).tobytes() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=batch.schema.names)

    rows = table.mapInArrow(run, ", ".join(f"{c} binary" for c in table.columns)).collect()
    return [[bytes(r[i]) for r in rows if r[i]] for i in range(len(table.columns))]


def head_count(words: DataFrame, head: int, n: str = "n") -> int:
    """The least count such that at most head words have it or more. Only numbers of words by count are looked at."""
    by_count = words.groupBy(F.col(n).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(head + 1)
    seen = (F.sum("words").over(Window.orderBy(F.desc("n")))).alias("seen")
    found = by_count.select("n", seen).agg(F.min(F.when(F.col("seen") <= head, F.col("n"))), F.max("n")).head()
    return found[0] if found[0] is not None else (found[1] or 0) + 1


def score_report(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, least: float = EVIDENCE, head: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words and one end. base_score is the smoothed unigram log10 probability of the tokens,
    score the tree's log10 probability of the text. The head most frequent words' counts reach all tasks; a text's
    rarer words are counted by a join on the word, one row for each text and word, and the tree's probabilities of
    grams go the same way. Null texts are empty: one
    token. Null keys are scored but not held out or learned from; repeated rows are scored alike; an empty table
    gives an empty one, and without training texts all distributions are uniform. Only key and text are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    ends = docs.where(learning(key)).count()
    words = scratch.keep(count_words(docs.where(learning(key)), text), "words")
    scratch.release()
    grams = scratch.keep(count_grams(docs, learning(key), text, depth), "grams")
    scratch.release()
    tree = scratch.keep(grow(grams, scratch, depth, least), "tree")
    scratch.release("grams")
    kinds, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    least_m = head_count(tree, head_grams, "m")
    keys, logp = gathered(tree.where(F.col("m") >= least_m).select("gram", "logp"))
    head_keys, head_logp = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(logp), np.float32)
    del keys, logp
    by = np.argsort(head_keys)
    head_keys, head_logp = head_keys[by], head_logp[by]
    n_train, n_kinds = total + ends, kinds + (ends > 0)
    least_n = head_count(words, head)
    top, top_n = gathered(words.where(F.col("n") >= least_n))
    told = spark.sparkContext.broadcast((head_keys, head_logp, b"\n".join(top), np.frombuffer(b"".join(top_n), np.int64)))
    del top, top_n, by, head_keys, head_logp
    size = n_train + 0.1 * (n_kinds + 1)
    p = lambda c: math.log10((c + 0.1) / size)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"), (~learning(key) & F.col(key).isNotNull()).alias("held_out"))
    kind = docs.schema[key].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, base double, score double, rare array<struct<word:binary,times:int>>, odd array<struct<gram:long,times:int>>"

    def run(batches):
        head_keys, head_logp, known, counts = told.value
        logs = {c: p(c) for c in set(counts.tolist())}
        weight = {w: logs[c] for w, c in zip(known.split(b"\n"), counts.tolist(), strict=True)} if len(counts) else {}
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))
        end = p(ends)
        for batch, texts in slices(batches, "__text", _LOOKED_UP):
            both = [token_line(t) for t in texts]
            score, odd = score_grams([x for _, x in both], head_keys, head_logp, depth)
            base, n_head, rare = [], [], []
            for own, _ in both:
                got = list(map(weight.get, own))
                n_rare = got.count(None)
                if n_rare:
                    times: dict[bytes, int] = {}
                    for w, g in zip(own, got, strict=True):
                        if g is None:
                            times[w] = times.get(w, 0) + 1
                    rare.append([{"word": w, "times": n} for w, n in times.items()])
                    got = [g for g in got if g is not None]
                else:
                    rare.append([])
                base.append(math.fsum(got) + end)
                n_head.append(len(own) - n_rare + (ends > 0))
            fields = [("doc_id", batch.column(0).type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", rare_type), ("odd", odd.type)]
            yield batch_of(pa.schema(fields), batch.column(0), batch.column(2), [len(w) + 1 for w, _ in both], n_head, base, pa.array(score), rare, odd)

    scored = scratch.keep(rows.mapInArrow(run, out).withColumn("row", F.monotonically_increasing_id()), "scored")
    each = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times")
    met = each.join(words.where(F.col("n") < least_n), "word", "left")
    c = F.coalesce("n", F.lit(0))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(size))).alias("rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    rare = scratch.keep(scored.select("row", F.explode("odd").alias("x")).select("row", "x.gram", "x.times"), "odd")
    tails = rare.join(tree.where(F.col("m") < least_m).select("gram", "logp"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("tail"))
    done = scored.drop("rare", "odd").join(sums, "row", "left").join(tails, "row", "left")
    return scratch.last(done.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score")))
