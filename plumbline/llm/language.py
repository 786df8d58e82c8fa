"""Language identification with a linear-chain conditional random field over words.

A text's words are labelled with languages by one chain over the whole text. Emissions sum weights of
hashed byte n-grams, prefixes, suffixes, the whole word and per-language lexicons of frequent words;
transitions between neighbouring labels are learned with them, on stretches of one language and on
code-switched ones joined from two. Forward-backward gives each word's marginals; their mean over the words
with a letter gives the text's language and score, and runs of words with one best label its passages.

Chains are worked on in stretches of STRETCH words side by side: each stretch's product of potentials tells what it
passes on to the next, so the messages that enter it from both sides are those of the whole chain.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import batch_of, slices, slim

STRETCH = 64
#: Longer words are cut into pieces of so many bytes.
WORD_BYTES = 32
BUCKETS = 1 << 16
#: Bounds of the training sample: whole documents of each language, their characters together, languages.
SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGUAGES = 240, 800_000, 512
_LETTER = re.compile(r"[^\W\d_]")
_ROUNDS, _RATE, _DECAY = 24, 0.25, 1e-4
#: Stretches learned from side by side.
_SIDE = 1024


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: np.ndarray
    lexicon_label: np.ndarray


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words; those over WORD_BYTES in pieces."""
    words = text.decode().lower().encode().split()
    if text and max(map(len, words), default=0) > WORD_BYTES:
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return words


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def word_hashes(matrix: np.ndarray) -> np.ndarray:
    h = np.zeros(len(matrix), np.uint64)
    for j in range(matrix.shape[1]):
        c = matrix[:, j].astype(np.uint64)
        h = np.where(c > 0, (h ^ c) * np.uint64(0x100000001B3) + np.uint64(j + 1), h)
    return h


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)


def feature_columns(words: list[bytes], lexicon: np.ndarray, lexicon_label: np.ndarray) -> np.ndarray:
    """A row of weight numbers for each word; 0 is the empty feature."""
    width = max(map(len, words))
    raw = _matrix(words, width)
    n = len(words)
    size = (raw > 0).sum(axis=1) if not (raw == 0).any() else np.fromiter(map(len, words), np.int64, n)
    m = np.zeros((n, width + 2), np.uint64)
    m[:, 0] = 1
    m[:, 1 : width + 1] = raw
    m[np.arange(n), size + 1] = 2
    out = []
    put = lambda code, salt, ok: out.append(np.where(ok, 1 + (_mix(code, salt) % np.uint64(BUCKETS - 1)).astype(np.int64), 0))
    for order in (2, 3, 4):
        code = np.zeros((n, max(0, width + 3 - order)), np.uint64)
        for j in range(order):
            code = (code << np.uint64(9)) | m[:, j : j + code.shape[1]]
        put(code, order, np.arange(code.shape[1]) + order <= (size + 2)[:, None])
    at = np.arange(n)[:, None]
    for k in (2, 3, 4):
        for salt, start in ((10 + k, np.zeros(n, np.int64)), (20 + k, size - k)):
            cells = np.maximum(start, 0)[:, None] + 1 + np.arange(k)
            got = m[at, np.minimum(cells, width + 1)]
            code = np.zeros(n, np.uint64)
            for j in range(k):
                code = (code << np.uint64(9)) | got[:, j]
            put(code[:, None], salt, (size >= k)[:, None])
    h = word_hashes(raw)
    put(h[:, None], 40, np.ones((n, 1), bool))
    if len(lexicon):
        i = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        out.append(np.where(lexicon[i] == h, BUCKETS + lexicon_label[i], 0)[:, None])
    return np.concatenate(out, axis=1)


def emissions(words: list[bytes], model: Model, step: int = 4096) -> np.ndarray:
    """Log potentials of each label for each of the distinct words."""
    out = np.zeros((len(words), len(model.labels)), np.float32)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for i in range(0, len(order), step):
        part = order[i : i + step]
        cols = feature_columns([words[k] for k in part], model.lexicon, model.lexicon_label)
        total = np.zeros((len(part), len(model.labels)), np.float32)
        for j in range(cols.shape[1]):
            total += model.weights[cols[:, j]]
        out[part] = total
    return out


def forward_backward(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every position, and the summed pair marginals. scores: steps x stretches x labels.

    mask tells the positions that exist; they come first in each stretch.
    """
    steps, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(moves)
    a = np.empty_like(e)
    a[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for i in range(1, steps):
        x = (a[i - 1] @ t) * e[i]
        a[i] = np.where(mask[i][:, None], x / x.sum(axis=1, keepdims=True), a[i - 1])
    b = np.ones((n, k), e.dtype)
    out, pairs = np.empty_like(e), np.zeros((k, k))
    for i in range(steps - 1, -1, -1):
        p = a[i] * b
        out[i] = p / p.sum(axis=1, keepdims=True)
        if i:
            x = e[i] * b
            joint = a[i - 1][:, :, None] * t[None] * x[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += (joint * mask[i][:, None, None]).sum(axis=0)
            y = x @ t.T
            b = np.where(mask[i][:, None], y / y.sum(axis=1, keepdims=True), b)
    return out, pairs


def marginals(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray, nth: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """Marginals of every position of chains that are cut into stretches. scores: steps x stretches x labels.

    A chain's stretches follow each other; nth is a stretch's number in its chain and of the chain's number of
    stretches (by default each stretch is a chain).
    """
    steps, n, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(moves).astype(e.dtype)
    into, back = np.ones((n, k), e.dtype), np.ones((n, k), e.dtype)
    if nth is not None and n and of.max() > 1:
        many = np.flatnonzero(of > 1)
        product, closed = _products(e[:, many], mask[:, many], t)
        at = np.full(n, -1)
        at[many] = np.arange(len(many))
        for j in range(1, int(of.max())):
            here = np.flatnonzero(nth == j)
            x = np.einsum("nk,nkl->nl", into[here - 1], product[at[here - 1]])
            into[here] = x / x.sum(axis=1, keepdims=True)
        ahead = np.empty((n, k), e.dtype)  # what a stretch tells the one before it
        last = np.flatnonzero((nth == of - 1) & (of > 1))
        ahead[last] = closed[at[last]].sum(axis=2)
        for j in range(int(of.max()) - 2, -1, -1):
            here = np.flatnonzero((nth == j) & (nth < of - 1))
            x = ahead[here + 1] / ahead[here + 1].sum(axis=1, keepdims=True)
            back[here] = x @ t.T
            ahead[here] = np.einsum("nkl,nl->nk", product[at[here]], x)
    a = np.empty_like(e)
    a[0] = into * e[0]
    a[0] /= a[0].sum(axis=1, keepdims=True)
    for i in range(1, steps):
        x = (a[i - 1] @ t) * e[i]
        a[i] = np.where(mask[i][:, None], x / x.sum(axis=1, keepdims=True), a[i - 1])
    b = back
    for i in range(steps - 1, -1, -1):
        y = (e[i] * b) @ t.T
        a[i] *= b
        a[i] /= a[i].sum(axis=1, keepdims=True)
        b = np.where(mask[i][:, None], y / y.sum(axis=1, keepdims=True), b)
    return a


def _products(e: np.ndarray, mask: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch's potentials multiplied from its first word to its last, with and without the move behind it."""
    steps, n, k = e.shape
    product = np.broadcast_to(np.eye(k, dtype=e.dtype), (n, k, k)).copy()
    closed = product
    for i in range(steps):
        x = product * e[i][:, None, :]
        x /= x.max(axis=(1, 2), keepdims=True)
        on = mask[i][:, None, None]
        closed = np.where(on, x, closed)
        product = np.where(on, x @ t, product)
    return product, closed


def fit(sample: list[tuple[str, bytes]], seed: int = 5) -> Model:
    """A model from (language, text) rows by full-batch adaptive gradient ascent on the conditional likelihood."""
    labels = sorted({lang for lang, _ in sample})
    stretches = []
    counts = [Counter() for _ in labels]
    for lang, text in sample:
        words, k = split_words(text), labels.index(lang)
        counts[k].update(words)
        stretches += [(words[i : i + STRETCH], [k] * len(words[i : i + STRETCH])) for i in range(0, len(words), STRETCH)]
    rng = np.random.default_rng(seed)
    for _ in range(len(stretches) // 2):
        (w1, k1), (w2, k2) = (stretches[i] for i in rng.integers(0, len(stretches), 2))
        half = STRETCH // 2
        stretches.append((w1[:half] + w2[:half], k1[:half] + k2[:half]))
    lex: dict[bytes, int] = {}
    for k, c in enumerate(counts):
        for w, n in c.most_common(200):
            if n == max(x[w] for x in counts):
                lex[w] = k
    words = sorted(lex)
    hashes = np.concatenate([word_hashes(_matrix([w], len(w))) for w in words]) if words else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    lexicon, lexicon_label = hashes[order], np.array([lex[w] for w in words], np.int64)[order]
    if not labels or not words:
        return Model(labels, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels),) * 2), lexicon, lexicon_label)
    known: dict[bytes, int] = {}
    ids = np.zeros((STRETCH, len(stretches)), np.int64)
    gold = np.zeros((STRETCH, len(stretches)), np.int64)
    mask = np.zeros((STRETCH, len(stretches)), bool)
    for s, (ws, ks) in enumerate(stretches):
        for i, w in enumerate(ws):
            ids[i, s] = known.setdefault(w, len(known))
        gold[: len(ks), s], mask[: len(ks), s] = ks, True
    names = list(known)
    width = 4096
    columns = [feature_columns(names[i : i + width], lexicon, lexicon_label).astype(np.int32) for i in range(0, len(names), width)]
    n = len(labels)
    weights = np.zeros((BUCKETS + n, n), np.float32)
    moves = np.zeros((n, n))
    seen_w, seen_m = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    real = np.zeros((n, n))
    both = mask[1:] & mask[:-1]
    np.add.at(real, (gold[:-1][both], gold[1:][both]), 1)
    truth = np.eye(n, dtype=np.float32)
    total = mask.sum()
    for _ in range(_ROUNDS):
        e = np.concatenate([weights[c].sum(axis=1) for c in columns])
        by_word, pairs = np.zeros((len(names), n)), np.zeros((n, n))
        for s in range(0, len(stretches), _SIDE):
            i, ok = ids[:, s : s + _SIDE], mask[:, s : s + _SIDE]
            post, moved = forward_backward(e[i].astype(np.float64), ok, moves)
            error = ((truth[gold[:, s : s + _SIDE]] - post) * ok[:, :, None]).reshape(-1, n) / total
            by_word += np.stack([np.bincount(i.ravel(), error[:, k], len(names)) for k in range(n)], axis=1)
            pairs += moved
        step = np.zeros(weights.shape)
        start = 0
        for c in columns:
            g = by_word[start : start + len(c)]
            for k in range(n):
                step[:, k] += np.bincount(c.ravel(), np.repeat(g[:, k], c.shape[1]), len(weights))
            start += len(c)
        step[0] = 0
        step -= _DECAY * weights / total
        seen_w += (step * 100) ** 2
        weights += (_RATE * step * 100 / np.sqrt(seen_w)).astype(np.float32)
        push = (real - pairs) / total - _DECAY * moves
        seen_m += (push * 100) ** 2
        moves += _RATE * push * 100 / np.sqrt(seen_m)
    return Model(labels, weights, moves, lexicon, lexicon_label)


def _posteriors(texts: list[bytes], model: Model) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text (none where it has no letter), and for all of them the text, the marginals and whether there is a letter."""
    docs = [split_words(t) if _LETTER.search(t.decode()) else [] for t in texts]
    known: dict[bytes, int] = {}
    ids = [[known.setdefault(w, len(known)) for w in d] for d in docs]
    if not known or not model.labels:
        return docs, np.zeros(0, np.int64), np.zeros((0, len(model.labels))), np.zeros(0, bool)
    names = list(known)
    scores = emissions(names, model)
    has_letter = np.fromiter((_LETTER.search(w.decode(errors="replace")) is not None for w in names), bool, len(names))
    flat = np.fromiter((i for d in ids for i in d), np.int64, sum(map(len, ids)))
    sizes = np.array([len(d) for d in ids])
    pieces = -(-sizes // STRETCH)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    n = int(pieces.sum())
    doc = np.repeat(np.arange(len(docs)), sizes)
    inside = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    row, col = inside % STRETCH, first[doc] + inside // STRETCH
    grid = np.zeros((STRETCH, n), np.int64)
    mask = np.zeros((STRETCH, n), bool)
    grid[row, col], mask[row, col] = flat, True
    post = marginals(scores[grid], mask, model.moves, np.arange(n) - np.repeat(first, pieces), np.repeat(pieces, pieces))[row, col]
    return docs, doc, post, has_letter[flat]


def predict(texts: list[bytes], model: Model) -> list[tuple[str, float]]:
    """Language and score of each text."""
    _, doc, post, use = _posteriors(texts, model)
    if not len(doc):
        return [("und", 0.0)] * len(texts)
    k = len(model.labels)
    sums = np.stack([np.bincount(doc[use], post[use, j], len(texts)) for j in range(k)], axis=1)
    total = np.bincount(doc[use], minlength=len(texts))
    best = sums.argmax(axis=1)
    return [(model.labels[b], float(min(1.0, sums[i, b] / total[i]))) if total[i] else ("und", 0.0) for i, b in enumerate(best)]


def passages(texts: list[bytes], model: Model) -> list[list[tuple[str, int, int, float]]]:
    """Runs of words with the same best label in each text: language, first word, number of words, mean marginal."""
    docs, doc, post, use = _posteriors(texts, model)
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if not len(doc):
        return out
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    best, sure = post.argmax(axis=1), post.max(axis=1)
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]))
    ends = np.append(new[1:], len(best))
    for a, b in zip(new.tolist(), ends.tolist(), strict=True):
        i = int(doc[a])
        out[i].append((model.labels[best[a]], int(a - starts[i]), b - a, float(min(1.0, sure[a:b].mean()))))
    return out


def training_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """Whole texts of at most SAMPLE_DOCS rows of each language, together at most SAMPLE_CHARS characters of each.

    Rows are taken in the order of a hash of key and text while they fit; a text over an eighth of SAMPLE_CHARS is
    not drawn, so that one cannot stand for its language. A threshold on the hash, from the number of rows of the
    language, leaves a few times as many candidates, whatever the size of docs. Repeated rows may be drawn together.
    More than MAX_LANGUAGES languages are an error: none is left out silently.
    """
    h = F.xxhash64(F.lit(11), key, text)
    fits = F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS // 8)
    rows = docs.where(fits).select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return []
    # four times the sample is expected below the threshold
    below = [(r["lang"], min(1.0, 4 * SAMPLE_DOCS / r["rows"])) for r in sizes]
    share = F.create_map(*[F.lit(x) for pair in below for x in pair])
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= SAMPLE_DOCS)
    size = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("r"))
    found = ranked.withColumn("size", size).where(F.col("size") <= SAMPLE_CHARS).select("lang", "r", "text").collect()
    return [(r["lang"], r["text"].encode()) for r in sorted(found, key=lambda r: (r["lang"], r["r"]))]


def learnable(key: str = "doc_id"):
    """False for the held-out quarter: crc32 of the key as text modulo 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return fit(training_sample(docs.where(learnable(key)), key, text, lang))


def label_languages(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep (all by default) and, by names, language and score of whole texts; a narrow map.

    A null text, or one without a letter, gets `und` and score 0, as does every text where nothing was learned.
    Equal texts get equal results. The model's size is fixed by BUCKETS and the number of languages.
    """
    keep = docs.columns if keep is None else keep
    told = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    out = rows.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def run(batches):
        model = told.value
        for batch, texts in slices(batches, "__text", 2 << 20):
            got = predict(texts, model)
            own = [batch.column(n) for n in keep]
            fields = [pa.field(n, c.type) for n, c in zip(keep, own, strict=True)] + [pa.field(names[0], pa.string()), pa.field(names[1], pa.float64())]
            yield batch_of(pa.schema(fields), *own, [x for x, _ in got], [x for _, x in got])

    return rows.mapInArrow(slim(run), out)


def label_words(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "passages") -> DataFrame:
    """The columns in keep (all by default) and, by name, the passages of code-switched texts; a narrow map.

    A passage is a run of words with one best label: lang, first (its first word's number, from 0; words are those of
    split_words, so one over WORD_BYTES counts as several), words (how many) and score (their mean marginal). A null
    text, or one without a letter, has none, as has every text where nothing was learned.
    """
    keep = docs.columns if keep is None else keep
    if name in keep:
        raise ValueError(f"{name} is a column already; give another name")
    told = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kind = "array<struct<lang:string,first:int,words:int,score:double>>"
    out = rows.select(*keep, F.lit(None).cast(kind).alias(name)).schema
    arrow = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        model = told.value
        for batch, texts in slices(batches, "__text", 2 << 20):
            got = [[dict(zip(("lang", "first", "words", "score"), x, strict=True)) for x in p] for p in passages(texts, model)]
            own = [batch.column(n) for n in keep]
            fields = [pa.field(n, c.type) for n, c in zip(keep, own, strict=True)] + [pa.field(name, arrow)]
            yield batch_of(pa.schema(fields), *own, got)

    return rows.mapInArrow(slim(run), out)
