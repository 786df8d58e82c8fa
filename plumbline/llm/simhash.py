"""SimHash near-duplicate detection by a self-join of binary tries.

Fingerprints that differ in at most ERRORS bits are linked. The 64 bits are cut into ERRORS + 1 blocks. For any
two linked fingerprints there is a block to start from such that, reading on round the ring, after l blocks they
differ in at most l - 1 bits. So there is a trie for each starting block, over the bits in that order: a pair of
nodes is walked down together, differing bits add up, and the pair is pruned once they exceed the budget of
its depth. The first block must agree, which deals each trie into subtries that are joined independently.

A wider budget makes chance links between unlike texts. classes() can therefore take a second fingerprint, of the
same shingles under another seed: the tries are walked by the first one, and a pair found there must also keep
within a budget over all 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected
from plumbline.llm.shared import Scratch, batch_of, slices, slim

SHINGLE, ERRORS, SEED = 4, 4, 42
#: Near-duplicates of five-word shingles at a Jaccard similarity of 0.8: the shingle vectors' cosine is then about
#: 2 * 0.8 / 1.8, so that 15 % of the bits differ; bits of the first fingerprint, of both, and the second's seed.
WIDE_SHINGLE, WIDE_ERRORS, BOTH_ERRORS, SECOND_SEED = 5, 10, 22, 43
#: A subtrie with more fingerprints is joined in parts, two at a time.
SUBTRIE = 1_000_000
#: Fingerprints of whole subtries joined at once; node pairs and leaf pairs worked on at once.
_GATHER, _PAIRS, _LEAF = 250_000, 1 << 17, 256
_SPREAD = (np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).view(np.uint64).ravel()


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of the shingles, repeats included; of the whole sequence where it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends[min(width, len(words)) - 1 :], strict=False)]


def fingerprints_of(texts: list[bytes], width: int = SHINGLE, second: bool = False) -> np.ndarray:
    """A uint64 for each text, or a row of two: bits set in over half of its shingles' hashes."""
    hashes = [shingle_hashes(t, width) for t in texts]
    if second:
        return np.stack([_majority(hashes), _majority([_remixed(h) for h in hashes])], axis=1)
    return _majority(hashes)


def _remixed(hashes: list[int]) -> np.ndarray:
    """Other hashes of the same shingles, as good as independent of the given ones bit by bit."""
    x = np.array(hashes, np.uint64) + np.uint64(SECOND_SEED * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: list) -> np.ndarray:
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate([np.asarray(h, np.uint64) for h in hashes]) if len(hashes) else np.zeros(0, np.uint64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    # counts of eight bits share a word, so sums run over at most 255 hashes of one text
    cuts = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts, sizes[full], strict=True)])
    owner = np.searchsorted(cuts, starts)
    octets = flat.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        on = np.add.reduceat(sums, owner, axis=0) * 2 > sizes[full][:, None]
        out[full] |= (on.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64) << np.uint64(8 * k)
    return out


def blocks(errors: int) -> list[tuple[int, int]]:
    """First bit (from the top) and width of each block."""
    edges = [round(i * 64 / (errors + 1)) for i in range(errors + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def rotated(values: np.ndarray, bits: int) -> np.ndarray:
    return values if bits % 64 == 0 else (values << np.uint64(bits % 64)) | (values >> np.uint64(64 - bits % 64))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; labels are the least members."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def trie_join(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, errors: int, others: np.ndarray | None = None, both: int = 0) -> np.ndarray:
    """Class labels (the least index) of sorted values within their subtries, whose first block agrees.

    first is the starting block; values are rotated so that its bits lead. A node is a range of the sorted values.
    others are the second fingerprints, which differ with the first ones in at most both bits.
    """
    order = blocks(errors)
    widths = [order[(first + i) % len(order)][1] for i in range(len(order))]
    budget = np.repeat(np.arange(len(widths)), widths)
    n = len(values)
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def leaves(al, ah, bl, bh) -> None:
        """Compares the members of node pairs directly."""
        sizes = (ah - al) * (bh - bl)
        done = 0
        while done < len(sizes):
            upto = max(done + 1, done + int(np.searchsorted(np.cumsum(sizes[done:]), 1 << 21)))
            s = sizes[done:upto]
            k = np.repeat(np.arange(done, upto), s)
            at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            w = (bh - bl)[k]
            i, j = al[k] + at // w, bl[k] + at % w
            apart = np.bitwise_count(values[i] ^ values[j])
            near = (i < j) & (apart <= errors)
            if others is not None:
                i, j, apart = i[near], j[near], apart[near]
                near = apart + np.bitwise_count(others[i] ^ others[j]) <= both
            _merge(label, i[near], j[near])
            done = upto

    wide = ends - starts > 1
    stack = [(widths[0], starts[wide], ends[wide], starts[wide], ends[wide], np.zeros(int(wide.sum()), np.int64))]
    while stack:
        depth, al, ah, bl, bh, e = stack.pop()
        if not len(al):
            continue
        if len(al) > _PAIRS:
            half = len(al) // 2
            stack += [(depth, *(x[half:] for x in (al, ah, bl, bh, e))), (depth, *(x[:half] for x in (al, ah, bl, bh, e)))]
            continue
        small = (ah - al) * (bh - bl) <= _LEAF
        if depth == 64:
            small[:] = True
        leaves(al[small], ah[small], bl[small], bh[small])
        al, ah, bl, bh, e = (x[~small] for x in (al, ah, bl, bh, e))
        if not len(al):
            continue
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int64)
            ones[depth] = np.concatenate([[0], np.cumsum(bit)])
        c = ones[depth]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        apart = al != bl  # else both are one node, whose two mixed pairs are the same
        parts = [(al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1)]
        parts.append(tuple(x[apart] for x in (am, ah, bl, bm, e + 1)))
        al, ah, bl, bh, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (ah > al) & (bh > bl) & (e <= budget[depth]) & ~((al == bl) & (ah - al == 1))
        stack.append((depth + 1, al[keep], ah[keep], bl[keep], bh[keep], e[keep]))
    return label


def fingerprint_table(docs: DataFrame, keep: list[str], text: str = "text", width: int = SHINGLE, second: bool = False) -> DataFrame:
    """keep, __fp, the fingerprint as a signed long, and where asked __fp2, the second one, of whole texts."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    names = ["__fp", "__fp2"] if second else ["__fp"]
    out = rows.select(*keep).schema
    for name in names:
        out = out.add(name, "long")

    def run(batches):
        for batch, texts in slices(batches, "__text"):
            own = [batch.column(n) for n in keep]
            fields = [pa.field(n, c.type) for n, c in zip(keep, own, strict=True)] + [pa.field(n, pa.int64()) for n in names]
            prints = fingerprints_of(texts, width, second).reshape(len(texts), len(names))
            yield batch_of(pa.schema(fields), *own, *[pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(len(names))])

    return rows.mapInArrow(slim(run), out)


def links(nodes: DataFrame, errors: int = ERRORS, subtrie: int = SUBTRIE, fp: str = "__fp", both: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct nodes that hold together every class of linked ones.

    A node is its fingerprint, or with both, the budget over two fingerprints, has a name in __node and a second
    fingerprint in __fp2.

    Each subtrie gives a forest, not all its pairs, so edges are fewer than tries times fingerprints. A subtrie
    over the limit is dealt into parts by a hash, and every two parts are joined in a task of their own; the
    table of such subtries has at most tries x 2 ** 13 rows, whatever the data.
    """
    order = blocks(errors)
    turned = []
    for k, (at, width) in enumerate(order):
        turn = F.col(fp) if not at else F.shiftleft(fp, at).bitwiseOR(F.shiftrightunsigned(fp, 64 - at))
        turned.append(F.struct(F.lit(k).cast("long").alias("trie"), turn.alias("value"), F.shiftrightunsigned(turn, 64 - width).alias("head")))
    own = ["__fp2", "__node"] if both is not None else []
    rows = nodes.select(*own, F.explode(F.array(*turned)).alias("x")).select("x.*", *own)
    many = rows.groupBy("trie", "head").agg(F.count("*").alias("n")).where(F.col("n") > subtrie).select("trie", "head", F.ceil(F.col("n") / subtrie).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(many), ["trie", "head"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("value"), F.col("parts")).cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    paired = dealt.withColumn("other", other).select("trie", "head", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "value", *own)
    group = ["trie", "head", "p", "q"]
    ready = paired.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def join(keys: np.ndarray, values: np.ndarray, more: list[np.ndarray]) -> pa.RecordBatch:
            """Whole subtries of one trie."""
            trie = int(keys[0, 0])
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            group = np.cumsum(np.bincount(new, minlength=len(keys)))
            by = np.lexsort((values, group))
            values, more = values[by], [m[by] for m in more]
            ends = np.append(new[1:], len(keys))
            label = trie_join(values, new, ends, trie, errors, *([more[0].view(np.uint64), both] if more else []))
            hung = np.flatnonzero(label != np.arange(len(label)))
            back = more[1] if more else rotated(values, 64 - order[trie][0]).view(np.int64)
            return batch_of(schema, pa.array(back[hung]), pa.array(back[label[hung]]))

        def joined(keys: np.ndarray, values: np.ndarray, more: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in _by_trie(keys):
                yield join(keys[a:b], values[a:b], [m[a:b] for m in more])

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append([np.stack([c.astype(np.int64) for c in columns[:4]], axis=1), columns[4].view(np.uint64), *columns[5:]])
            size += batch.num_rows
            if size < _GATHER:
                continue
            keys, values, *more = map(np.concatenate, zip(*held, strict=True))
            last = len(keys) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) if (keys != keys[-1]).any() else 0
            yield from joined(keys[:last], values[:last], [m[:last] for m in more])
            held, size = [[x[last:] for x in (keys, values, *more)]], len(keys) - last
        if size:
            keys, values, *more = map(np.concatenate, zip(*held, strict=True))
            yield from joined(keys, values, more)

    return ready.mapInArrow(slim(run), "u long, v long")


def _by_trie(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with one trie each."""
    if not len(keys):
        return []
    cut = np.flatnonzero(keys[1:, 0] != keys[:-1, 0]) + 1
    return list(zip([0, *cut], [*cut, len(keys)], strict=True))


def classes(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", width: int = SHINGLE, errors: int = ERRORS, also: tuple[str, ...] = (), both: int | None = None) -> DataFrame:
    """Per document: key, also, __fp, __root and component_id, the smallest key that links lead to.

    With both, documents link if two fingerprints differ in at most errors bits of the first and both bits in all;
    a document's node is then a 64-bit hash of the two (chance collisions: rows squared over 2 ** 65).
    __root is the component's smallest node (its fingerprint without both) and its name where keys are null or repeated. Copies share a
    fingerprint and are joined as one; documents without words have fingerprint zero and link like
    any other. Null keys take part in links but are never a component_id, unless a component has no other.
    Repeated rows get equal results; an empty table an empty one.
    """
    table = fingerprint_table(docs.select(F.col(key), F.col(text), *also), [key, *also], text, width, both is not None)
    node = F.col("__fp") if both is None else F.xxhash64("__fp", "__fp2")
    prints = scratch.keep(table.withColumn("__node", node), "prints")
    own = [F.first(c).alias(c) for c in ("__fp", "__fp2") if both is not None]
    nodes = scratch.keep(prints.groupBy("__node").agg(F.min(key).alias("least"), *own), "nodes")
    roots = connected(links(nodes, errors, fp="__fp" if own else "__node", both=both), scratch)
    placed = nodes.join(roots, F.col("__node") == F.col("node"), "left").select("__node", "least", F.coalesce("root", "__node").alias("__root"))
    names = placed.groupBy("__root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "__root").select("__node", "__root", "component_id")
    return prints.join(named, "__node")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id.

    Nulls, ties, repeated rows and empty tables are as in classes; only key and text are read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = classes(docs, scratch, key, text)
    return scratch.last(found.select(F.col(key).alias("doc_id"), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDE_SHINGLE, errors: int = WIDE_ERRORS, both: int = BOTH_ERRORS) -> DataFrame:
    """docs with one row of each component: of its smallest key (null only if it has no other) and, of that, the least text digest.

    Components are near-duplicates by five-word shingles, of a similarity of about 0.8 or more. Rows of one key or
    without a key are told apart by their texts, so each component keeps its own; of rows equal in key and text, one
    stays, whatever their other columns. Null texts count as empty: they and texts without words are one component.
    Texts are not shuffled: the rows of each key and digest are numbered without them. An empty table gives an empty
    one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    told = docs.withColumns({"__digest": F.sha2(F.col(text).cast("binary"), 256), "__row": F.monotonically_increasing_id()})
    # the row numbers must be the same when docs is read again: they are those of a written table
    held = scratch.keep(told, "rows")
    found = classes(held, scratch, key, text, width, errors, also=("__digest", "__row"), both=both)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "__digest", F.col("__row").alias("row"))
    chosen = found.groupBy("__root").agg(F.min(order).alias("x")).select(F.col("x.row").alias("__row"))
    return scratch.last(held.join(chosen, "__row", "left_semi").select(*docs.columns))
