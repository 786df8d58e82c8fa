"""Removal of repeated byte strings by suffix arrays.

Every WIDTH-byte string that starts at two or more places of the corpus is found, and the bytes it covers go.
No machine sorts the corpus's suffixes. A string's anchor is the least of the hashes of its GRAM-byte windows
(the leftmost of equals): the same for equal strings, wherever they are. The strings of one anchor lie in one
context of the text, so strings can only be equal within contexts whose anchors have one hash. Contexts whose hash
occurs once are settled; the others are dealt out by hash, copies combined with their number, and each task
sorts the suffixes of its contexts block by block by two-stage sorting and compares neighbours.

A hash with very many contexts is dealt out in parts. Each part sorts its own suffixes and sends on one digest
for each different string; strings whose digest comes from two parts are repeated too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import ROW_GROUP, Scratch, batch_of, slices, slim
from plumbline.llm.suffix_array import common_prefixes, smaller_than_successor, suffix_array, window_hashes

WIDTH, GRAM = 200, 40
#: Bytes of contexts sorted at once; contexts of one hash in a part.
BLOCK_BYTES, PART_CONTEXTS = 1 << 20, 4096
#: Tasks that the contexts of one hash may meet its number of parts in.
_SALTS = 64
_END = 0xFF  # never in UTF-8


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, first start, number of starts and anchor hash of each context, in order.

    The starts of a context are the places in its text whose width-byte strings share its anchor; each place
    where such a string starts is in one context.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    span = width - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    if len(data) < width:
        return none
    h = window_hashes(data, gram)
    least = sliding_min(h, span)
    n = len(least)
    doc = np.repeat(np.arange(len(texts)), sizes)[:n]
    valid = np.arange(n) + width <= (begins + sizes)[doc]
    change = np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])])
    lo = np.flatnonzero(change)
    hi = np.append(lo[1:], n)
    keep = valid[lo]
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return none
    # places that are the least of some window; for each run of starts the leftmost of them with its hash
    lowest = np.flatnonzero(h == sliding_max_back(least, span, len(h)))
    found_lo, found_hi, found_at = [], [], []
    while len(lo):
        j = np.searchsorted(lowest, lo)
        open_ = np.arange(len(lo))
        while len(open_):
            open_ = open_[h[lowest[j[open_]]] != least[lo[open_]]]
            j[open_] += 1
        at = lowest[j]
        upto = np.minimum(hi, at + 1)
        found_lo.append(lo)
        found_hi.append(upto)
        found_at.append(at)
        more = upto < hi
        lo, hi = upto[more], hi[more]
    lo, hi, at = (np.concatenate(x) for x in (found_lo, found_hi, found_at))
    order = np.argsort(lo, kind="stable")
    lo, hi, at = lo[order], hi[order], at[order]
    d = doc[lo]
    return d, lo - begins[d], hi - lo, h[at]


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The least of x[i : i + span] for each i, by minima of blocks from both sides."""
    n = len(x)
    if n < span:
        return x[:0]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    full = np.full(-(-n // span) * span, top, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, span)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - span + 1], left[span - 1 : n])


def sliding_max_back(x: np.ndarray, span: int, n: int) -> np.ndarray:
    """For each place p below n the greatest of x[p - span + 1 : p + 1], as far as x goes."""
    padded = np.zeros(n + span - 1, np.uint64)
    padded[span - 1 : span - 1 + len(x)] = x
    return ~sliding_min(~padded, span)


def block_repeats(contexts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the strings of a block of contexts: context and start of each, and a label shared by equal ones."""
    data = np.frombuffer(b"".join(c + bytes([_END]) for c in contexts), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    begins = np.cumsum(sizes) - sizes
    # where strings start, and on to the next suffix of type B: what places those of type A before it
    is_b = smaller_than_successor(data)
    starts = np.maximum(sizes - width, 0)
    b = np.flatnonzero(is_b)
    last = b[np.minimum(np.searchsorted(b, begins + starts), len(b) - 1)]
    wanted = np.zeros(len(data) + 1, np.int64)
    np.add.at(wanted, begins[starts > 0], 1)
    np.add.at(wanted, last[starts > 0] + 1, -1)
    order = suffix_array(data, width, is_b, np.cumsum(wanted[:-1]) > 0)
    # neighbours whose strings' hashes differ share less than width bytes; the others are compared byte by byte
    hashes = np.append(window_hashes(data, width), np.zeros(min(width - 1, len(data)), np.uint64))
    near = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]]) + 1
    shared = common_prefixes(data, order, width, near)
    label = np.zeros(len(data), np.int64)
    label[order] = np.cumsum(shared < width)
    which = np.repeat(np.arange(len(contexts)), sizes)
    start = np.arange(len(data)) - begins[which]
    whole = start + width < sizes[which]
    return which[whole], start[whole], label[whole]


def spans(flags: np.ndarray, owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, first and end of each run of flagged neighbours; owner and start rise together."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return owner[first], start[first], start[last] + 1


def covered(starts: list[tuple[int, int]], width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start within the given ranges."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + width)
        else:
            out.append([a, b - 1 + width])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _digest(text: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(text)


def repeated(docs: DataFrame, scratch: Scratch, text: str = "text", width: int = WIDTH, gram: int = GRAM, part: int = PART_CONTEXTS) -> DataFrame:
    """A row for each different text with repeated strings: digest, n_removed, n_spans, kept_sha256, kept.

    kept is the text without the covered bytes. Texts below width bytes (nulls count as empty) have none.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        schema = pa.schema([("digest", pa.binary()), ("packed", pa.binary())])
        for _, texts in slices(batches, "__text"):
            texts = [t for t in texts if len(t) >= width]
            yield batch_of(schema, [_digest(t) for t in texts], [tool.compress(t) for t in texts])

    # different texts, dealt out and stored by digest once: later joins on it move no text
    packed = docs.select(F.col(text).alias("__text")).mapInArrow(slim(pack), "digest binary, packed binary")
    table = f"plumbline_texts_{scratch.root.rsplit('-', 1)[1]}"
    once = packed.groupBy("digest").agg(F.first("packed").alias("packed"), (F.count("*") > 1).alias("copied"))
    once.repartition(parts, "digest").write.bucketBy(parts, "digest").format("parquet").options(path=scratch.path("texts"), **ROW_GROUP).saveAsTable(table)
    scratch.own_table(table)

    def find(batches):
        import zstandard
        from xxhash import xxh3_64_intdigest

        tool = zstandard.ZstdDecompressor()
        schema = pa.schema([("digest", pa.binary()), ("hash", pa.int64()), ("content", pa.int64()), ("first", pa.int32()), ("starts", pa.int32()), ("copied", pa.bool_())])
        for batch in batches:
            digests, copied = batch.column("digest").to_pylist(), batch.column("copied").to_pylist()
            for some in _by_bytes(batch.column("packed"), tool):
                texts = [t for _, t in some]
                d, first, starts, h = anchors(texts, width, gram)
                content = np.fromiter((xxh3_64_intdigest(texts[i][a : a + n - 1 + width]) for i, a, n in zip(d.tolist(), first.tolist(), starts.tolist(), strict=True)), np.uint64, len(d))
                row = [some[i][0] for i in d.tolist()]
                yield batch_of(schema, [digests[r] for r in row], pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(starts.astype(np.int32)), [copied[r] for r in row])

    texts = spark.table(table)
    found = scratch.keep(texts.mapInArrow(slim(find), "digest binary, hash long, content long, first int, starts int, copied boolean"), "anchors")
    again = found.groupBy("hash").agg(F.count("*").alias("n"), F.bool_or("copied").alias("copied")).where("n > 1 OR copied").select("hash")
    again = scratch.keep(again, "again")  # as a table, so that the join can split a hash that very many contexts have
    open_ = scratch.keep(found.join(again, "hash"), "candidates")
    scratch.release("anchors", "again")
    # one row for each different context, with one place to read it at
    each = open_.groupBy("hash", "content").agg((F.bool_or("copied") | (F.count("*") > 1)).alias("many"), F.min(F.struct("digest", "first", "starts")).alias("place"))
    each = scratch.keep(each.select("hash", "content", "many", "place.*"), "contexts")
    large = each.groupBy("hash").agg(F.count("*").alias("m")).where(F.col("m") > part).select("hash", F.ceil(F.col("m") / part).cast("int").alias("parts"))
    # by hash and content, so that a hash with very many contexts is not one task's
    salt = F.pmod(F.xxhash64("content"), F.lit(_SALTS)).cast("int")
    spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = each.withColumn("salt", salt).join(spread, ["hash", "salt"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"), F.lit(-1)))
    lists = dealt.groupBy("digest").agg(F.collect_list(F.struct("hash", "content", "many", "first", "starts", "part")).alias("wanted"))

    def cut(batches):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        schema = pa.schema([("hash", pa.int64()), ("part", pa.int32()), ("content", pa.int64()), ("many", pa.bool_()), ("context", pa.binary())])
        for batch in batches:
            wanted = batch.column("wanted")
            for some in _by_bytes(batch.column("packed"), tool):
                rows = [(x, t) for r, t in some for x in wanted[r].as_py()]
                yield batch_of(schema, *[[x[c] for x, _ in rows] for c in ("hash", "part", "content", "many")], [t[x["first"] : x["first"] + x["starts"] - 1 + width] for x, t in rows])

    contexts = texts.join(lists, "digest").select("packed", "wanted").mapInArrow(slim(cut), "hash long, part int, content long, many boolean, context binary")

    def sort(batches):
        schema = pa.schema([("hash", pa.int64()), ("content", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("string", pa.binary())])

        def settle(rows):
            """rows: (hash, part, content, many, context) of whole groups."""
            owner, start, label = block_repeats([r[4] for r in rows], width)
            times = np.bincount(label)
            many = np.array([r[3] for r in rows])
            flags = (times[label] > 1) | many[owner]
            out = [[rows[i][0], rows[i][2], a, b, None] for i, a, b in zip(*(x.tolist() for x in spans(flags, owner, start)), strict=True)]
            sent = set()
            for k in np.flatnonzero(np.array([r[1] >= 0 for r in rows])[owner]).tolist():
                if (lab := int(label[k])) in sent:
                    continue
                sent.add(lab)
                row, s = rows[owner[k]], int(start[k])
                string = _digest(row[4][s : s + width])
                out.append([row[0], None if flags[k] else row[2], s, s + 1, string])
            return batch_of(schema, *zip(*out, strict=True)) if out else None

        waiting, size, group = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != group and size >= BLOCK_BYTES or row[1] >= 0 and row[:2] != group:
                    if waiting and (done := settle(waiting)):
                        yield done
                    waiting, size = [], 0
                group = row[:2]
                waiting.append(row)
                size += len(row[4]) + 1
        if waiting and (done := settle(waiting)):
            yield done

    ready = contexts.repartition(parts, "hash", "part").sortWithinPartitions("hash", "part")
    settled = scratch.keep(ready.mapInArrow(slim(sort), "hash long, content long, a int, b int, string binary").hint("rebalance"), "settled")
    # strings that two parts of one hash have
    shared = settled.where("string IS NOT NULL").groupBy("hash", "string").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("content").isNotNull(), F.struct("content", "a", "b"))).alias("at")).where("n > 1")
    across = shared.select("hash", F.explode("at").alias("at")).select("hash", "at.content", "at.a", "at.b")
    ranges = settled.where("string IS NULL").select("hash", "content", "a", "b").unionByName(across)
    back = open_.join(ranges, ["hash", "content"]).select("digest", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    gone = back.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def remove(batches):
        import zstandard

        tool, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        schema = pa.schema([("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for batch in batches:
            digests, ranges = batch.column("digest").to_pylist(), batch.column("ranges")
            for some in _by_bytes(batch.column("packed"), tool):
                runs = [covered([(x["a"], x["b"]) for x in ranges[r].as_py()], width) for r, _ in some]
                left = [kept_bytes(t, run) for (_, t), run in zip(some, runs, strict=True)]
                yield batch_of(schema, [digests[r] for r, _ in some], [len(t) - len(k) for (_, t), k in zip(some, left, strict=True)], [len(run) for run in runs], [hashlib.sha256(k).hexdigest() for k in left], [press.compress(k) for k in left])

    return texts.join(gone, "digest").mapInArrow(slim(remove), "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _by_bytes(packed: pa.Array, tool, limit: int = 1 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """Row numbers and texts, about limit bytes at a time."""
    some, size = [], 0
    for i in range(len(packed)):
        some.append((i, tool.decompress(packed[i].as_py())))
        size += len(some[-1][1])
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def _keyed(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, __digest, __bytes and __sha256 of each text."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    out = rows.select(*keep).schema.add("__digest", "binary").add("__bytes", "long").add("__sha256", "string")

    def run(batches):
        for batch, texts in slices(batches, "__text"):
            own = [batch.column(n) for n in keep]
            fields = [pa.field(n, c.type) for n, c in zip(keep, own, strict=True)] + [pa.field("__digest", pa.binary()), pa.field("__bytes", pa.int64()), pa.field("__sha256", pa.string())]
            yield batch_of(pa.schema(fields), *own, [_digest(t) for t in texts], [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts])

    return rows.mapInArrow(slim(run), out)


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every copy of a repeated string goes, the first included; copies of whole texts of WIDTH bytes or more lose
    all. Strings are judged on the input. Null texts are empty. Repeated rows, also of one key, are copies of each
    other. Only key and text are read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    result = repeated(docs, scratch, text, **how).drop("kept")
    rows = _keyed(docs, [key], text).join(result, F.col("__digest") == F.col("digest"), "left")
    out = rows.select(F.col(key).alias("doc_id"), F.col("__bytes").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "__sha256").alias("kept_sha256"))
    return scratch.last(out)


def dedup_texts(docs: DataFrame, text: str = "text", chars: str | None = None, **how) -> DataFrame:
    """docs with repeated strings cut out of text, and without documents of which no word is left by that.

    Bytes of characters cut in two go too. chars names a column to set to the new text's length. Texts without
    repeats, nulls included, are unchanged. Repeated rows are copies of each other: all lose what they share. Other
    columns pass through; an empty table gives an empty one. The result reads one table of kept texts, which
    sweep() deletes once it is written.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    kept = repeated(docs, scratch, text, **how).select(F.col("digest").alias("__result"), F.col("kept").alias("__kept"))
    result = scratch.last(kept)
    keyed = _with_digest(docs, text)
    joined = keyed.join(result, F.col("__digest") == F.col("__result"), "left")

    def run(batches):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            kept = batch.column("__kept")
            new = [None if not k.is_valid else tool.decompress(k.as_py()).decode(errors="ignore") for k in kept]
            old = batch.column(text)
            texts = pa.array([o.as_py() if n is None else n for n, o in zip(new, old, strict=True)], pa.string())
            hit = pa.array([n is not None for n in new])
            yield pa.RecordBatch.from_arrays([texts if f == text else batch.column(f) for f in docs_columns] + [hit], names=[*docs_columns, "__hit"])

    docs_columns = docs.columns
    out = joined.select(*docs_columns, "__kept").mapInArrow(slim(run), docs.select(*docs_columns, F.lit(True).alias("__hit")).schema)
    if chars:
        out = out.withColumn(chars, F.when(F.col("__hit"), F.length(text).cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    return out.where(~F.col("__hit") | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(*docs_columns)


def _with_digest(docs: DataFrame, text: str) -> DataFrame:
    names = docs.columns
    out = docs.select(*names, F.lit(None).cast("binary").alias("__digest")).schema

    def run(batches):
        for batch, texts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([_digest(t) for t in texts], pa.binary())], names=[*names, "__digest"])

    return docs.mapInArrow(slim(run), out)
