"""Document fingerprints: content-defined chunks, their digests and lengths.

A gear hash rolls over the UTF-8 bytes: at each byte the last 32 bytes' table values, shifted by their
distance, are summed. A chunk may end where the hash's high bits are zero; chunks below the normal size need
more zero bits than those above it, so sizes gather near it. A boundary depends on 32 bytes only: an insertion
moves the chunks behind it but changes no more than the one or two around it. A fingerprint is the set of
chunk digests with their lengths; containment is the share of one text's chunk bytes that the other has too.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import SLICE_BYTES, batch_of, slices

#: Chunk sizes in bytes; the hash has a window of MIN_CHUNK bytes, so no boundary sees a text's neighbour.
MIN_CHUNK, NORMAL_CHUNK, MAX_CHUNK = 32, 64, 256
_STRICT, _LOOSE = np.uint32(0xFF << 24), np.uint32(0xF << 28)
#: Ranges of the key that documents are dealt into; at most so many rows of bounds reach the driver.
MAX_RANGES = 4096


def gear_table() -> np.ndarray:
    """256 values of 32 bits from a multiplicative mixing rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hash after each byte, by doubling the window five times."""
    h = table[data]
    for step in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h = wider
    return h


def cut_points(texts: list[bytes], table: np.ndarray) -> Iterator[list[int]]:
    """For each text the ends of its chunks."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gear_hash(data, table) if len(data) else np.zeros(0, np.uint32)
    strict = (np.flatnonzero((h & _STRICT) == 0) + 1).tolist()
    loose = (np.flatnonzero((h & _LOOSE) == 0) + 1).tolist()
    n_strict, n_loose, at = len(strict), len(loose), 0
    for text in texts:
        start, end, ends = at, at + len(text), []
        pos = start
        while end - pos > MIN_CHUNK:
            normal, most = min(pos + NORMAL_CHUNK, end), min(pos + MAX_CHUNK, end)
            i = bisect_left(strict, pos + MIN_CHUNK)
            if i < n_strict and strict[i] < normal:
                cut = strict[i]
            else:
                i = bisect_left(loose, normal)
                cut = loose[i] if i < n_loose and loose[i] < most else most
            ends.append(cut - start)
            pos = cut
        if pos < end:
            ends.append(end - start)
        at = end
        yield ends


def chunk_sets(texts: list[bytes], table: np.ndarray) -> list[dict[int, int]]:
    """For each text the 48-bit digests of its chunks with their lengths."""
    from xxhash import xxh3_64_intdigest

    out = []
    for text, ends in zip(texts, cut_points(texts, table), strict=True):
        found, start = {}, 0
        for end in ends:
            found[xxh3_64_intdigest(text[start:end]) >> 16] = end - start
            start = end
        out.append(found)
    return out


def encode_set(chunks: dict[int, int]) -> str:
    """Sorted digests with their lengths, eight bytes each, in base64."""
    if not chunks:
        return ""
    packed = np.fromiter(chunks, np.uint64, len(chunks)) << np.uint64(16) | np.fromiter(chunks.values(), np.uint64, len(chunks))
    packed.sort()
    return base64.b64encode(packed.astype(">u8").tobytes()).decode()


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's chunk bytes that b has too; an empty text is contained in an empty one only."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / total


def edited(text: str, other: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint: a narrow map, for any table with a text column (null: empty)."""
    out = docs.select("*", F.lit(None).cast("string").alias("fingerprint")).schema

    def run(batches):
        table = gear_table()
        for batch, texts in slices(batches, text):
            marks = pa.array([encode_set(x) for x in chunk_sets(texts, table)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, out)


def in_ranges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in descending order of key within ranges, each range ended by the first row of the next one.

    Columns: __range, __tail (1 for that row, which belongs to the next range), key, text. The order is total up
    to equal rows: key (nulls last), then a hash of the text. One exchange; the first row of each range, at most
    MAX_RANGES keys, is found by an aggregation of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(MAX_RANGES, 4 * parts)
    probs = [i / n for i in range(1, n)]
    bounds = sorted(set(docs.select(F.col(key).cast("double").alias("k")).where("k IS NOT NULL").approxQuantile("k", probs, 0.25 / n)))
    place = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<double>"), lambda b: b > F.col("__key").cast("double")))
    ranged = rows.withColumn("__range", F.when(F.col("__key").isNull(), F.lit(len(bounds) + 1)).otherwise(place))
    tops = ranged.groupBy("__range").agg(F.max(F.struct("__key", "__hash")).alias("top")).orderBy("__range").collect()
    ends = [(a["__range"], b["top"]["__key"], b["top"]["__hash"]) for a, b in zip(tops, tops[1:] + tops[:1], strict=True)]
    ends_df = spark.createDataFrame(ends, f"__range int, k {docs.schema[key].dataType.simpleString()}, h long")
    tails = rows.join(F.broadcast(ends_df), F.col("__key").eqNullSafe(F.col("k")) & (F.col("__hash") == F.col("h"))).dropDuplicates(["__range"])
    both = ranged.select("__range", F.lit(0).alias("__tail"), "__key", "__text", "__hash").unionByName(tails.select("__range", F.lit(1).alias("__tail"), "__key", "__text", "__hash"))
    return both.repartition(parts, "__range").sortWithinPartitions("__range", "__tail", F.desc_nulls_last("__key"), F.desc("__hash"))


def fingerprint_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text takes its end from the next document in descending order of key (after the last the first;
    a sole document follows itself); near_edited and near_next are the containment of the document's fingerprint
    in the edited text's and the next document's. Null texts are empty; an empty text's fingerprint is the empty
    string. Null keys come last; rows with equal keys are ordered by a hash of their texts, and equal rows are
    interchangeable. An empty table gives an empty one. Other columns are not read.
    """
    rows = in_ranges(docs, key, text).select("__range", "__tail", "__key", "__text")
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def report(keys, texts, nexts, table, key_type):
        """texts[i]'s next document is nexts[i]."""
        both = [edited(a.decode(), b.decode()).encode() for a, b in zip(texts, nexts, strict=True)]
        own, new = chunk_sets(texts, table), chunk_sets(both, table)
        after = [b if x is y else None for b, x, y in zip(own[1:] + [None], texts[1:] + [None], nexts, strict=True)]
        rest = iter(chunk_sets([y for a, y in zip(after, nexts, strict=True) if a is None], table))
        after = [next(rest) if a is None else a for a in after]
        columns = [
            pa.array(keys, key_type),
            pa.array([len(x.decode()) for x in texts], pa.int64()),
            [hashlib.sha256(x).hexdigest() for x in both],
            [encode_set(x) for x in own],
            [encode_set(x) for x in new],
            [containment(a, b) for a, b in zip(own, new, strict=True)],
            [containment(a, b) for a, b in zip(own, after, strict=True)],
        ]
        types = [key_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        return batch_of(pa.schema(list(zip(names, types, strict=True))), *columns)

    def run(batches):
        table, last, size = gear_table(), None, 0
        keys, texts, nexts, key_type = [], [], [], None
        for batch in batches:
            key_type = batch.column("__key").type
            content = batch.column("__text").cast(pa.binary())
            for r, tail, k, at in zip(batch.column("__range").to_pylist(), batch.column("__tail").to_pylist(), batch.column("__key").to_pylist(), range(len(content)), strict=True):
                t = content[at].as_py()
                if last is not None and last[0] == r:
                    keys.append(last[1])
                    texts.append(last[2])
                    nexts.append(t)
                    size += len(last[2])
                    if size >= SLICE_BYTES:
                        yield report(keys, texts, nexts, table, key_type)
                        keys, texts, nexts, size = [], [], [], 0
                last = None if tail else (r, k, t)
        if keys:
            yield report(keys, texts, nexts, table, key_type)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
