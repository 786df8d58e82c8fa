"""Each operator against a plain version, on small and odd tables."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, fingerprint, language, mixing, quality, simhash, substring_dedup, suffix_array, suffix_tree, url_filter, warc
from plumbline.llm.components import connected
from plumbline.llm.shared import Scratch, slim

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, null and equal keys."""
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "ber", "th", "é", "re", "Qu", "o"]) for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(r.randint(1, 120))) + r.choice(["", "\n", " . "]) for _ in range(40)]
    shared = " ".join(word() for _ in range(70))
    texts += [t + " " + shared + " " + word() for t in texts[:6]]
    texts += texts[:5] + [texts[7] + " tail", "", " \n\t ", "a", "ñ" * 300, "ab " * 400, "x" * 50_000, "one two three", "ONE two three", shared, "\x1c\x1d é", "### $$$ %%% &&& ||| <<< >>> *** %%% $$$ ###"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s2", None][i % 4], len(t), i, "d") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no key at all here", None, None, 1, 1, "d"), (None, None, "en", "s1", None, None, None), (500, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def texts_of(rows=None):
    return {r[0]: r[1] or "" for r in rows or corpus() if r[0] is not None}


# --- suffix arrays --------------------------------------------------------------------------------------


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n = int(rng.integers(1, 300))
        data = rng.integers(97, 97 + int(rng.integers(1, 5)), n).astype(np.uint8)
        data = np.tile(data, 3) if trial % 3 == 0 else data
        depth = int(rng.choice([8, 16, 40, 200]))
        order, t = suffix_array.suffix_array(data, depth), data.tobytes()
        assert sorted(order) == list(range(len(data)))
        keys = [t[i : i + depth] for i in order]
        assert keys == sorted(keys)
        for k, n in enumerate(suffix_array.common_prefixes(data, order, depth).tolist()):
            assert n == (len(os.path.commonprefix([keys[k], keys[k - 1]])) if k else 0)


def slow_dedup(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        cover = np.cumsum(gone)[:-1] > 0 if len(t) else np.zeros(0, bool)
        runs = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, cover, strict=True) if not g)
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("part", [4096, 2])
def test_dedup(docs, part):
    got = Counter(tuple(r)[:5] for r in substring_dedup.dedup_report(docs, width=60, gram=16, part=part).collect())
    rows = corpus()
    want = slow_dedup([(r[1] or "").encode() for r in rows], 60)
    assert got == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))


def test_anchors_cover_every_start():
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(n)).encode() for n in (3, 60, 61, 300, 900)] + [b"a" * 400, b"abc" * 200]
    d, first, starts, h = substring_dedup.anchors(texts, 60, 16)
    found = {(a, i): x for a, f, n, x in zip(d.tolist(), first.tolist(), starts.tolist(), h.tolist(), strict=True) for i in range(f, f + n)}
    assert set(found) == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 59)}
    strings = defaultdict(set)
    for (k, i), x in found.items():
        strings[texts[k][i : i + 60]].add(x)
    assert all(len(x) == 1 for x in strings.values())


def test_dedup_texts(docs):
    out = substring_dedup.dedup_texts(docs, chars="n_chars", width=60, gram=16)
    assert out.columns == docs.columns
    rows, long = out.collect(), {t for t, n in Counter(t for t in texts_of().values()).items()}
    assert len(long) > 1 and all(r.n_chars == len(r.text) for r in rows if r.text is not None and r.doc_id not in (None, 500))
    assert {r.doc_id for r in rows} <= {r[0] for r in corpus()}


# --- language model -------------------------------------------------------------------------------------


def test_scores(docs):
    rows = corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + ["\n"]
    train = Counter(x for r in rows if r[0] is not None and not held(r[0]) for x in tokens(r[1]))
    total, kinds = sum(train.values()), len(train)
    for head in (1 << 17, 5):
        got = suffix_tree.score_report(docs, head=head).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert not r.held_out
                continue
            t = tokens(texts_of()[r.doc_id])
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(x in train for x in t), total)
            assert r.base_score == pytest.approx(sum(np.log10((train[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in t), rel=1e-9)


def plain_tree(lines, depth, times=1):
    """Counts by context, the retained contexts, and the probability of a byte after a history."""
    counts = defaultdict(Counter)
    for line in lines:
        s = b"\n" * depth + line + b"\n"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[s[i - d : i]][s[i]] += times

    def evident(c, own):
        up = counts[c[1:]]
        gain = sum(n * np.log(n / sum(own.values()) / (up[b] / sum(up.values()))) for b, n in own.items())
        return gain > suffix_tree.EVIDENCE * len(own)

    kept = {b""} | {c for c, own in counts.items() if c and evident(c, own)}

    def prob(history, byte):
        q, order = 1 / 256, 0
        for d in range(depth + 1):
            c = history[len(history) - d :]
            if c in kept:
                own = counts[c]
                q, order = (own[byte] + len(own) * q) / (sum(own.values()) + len(own)), d
        return q, order

    return counts, kept, prob


def test_scores_follow_the_longest_retained_suffix(docs):
    depth = suffix_tree.DEPTH
    lines = {i: b" ".join(t.encode().lower().split()) for i, t in texts_of().items()}
    _, kept, prob = plain_tree([lines[r[0]] for r in corpus() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10], depth)
    assert any(len(c) == depth for c in kept)
    want = {}
    for i, line in lines.items():
        s = b"\n" * depth + line + b"\n"
        want[i] = sum(np.log10(prob(s[k - depth : k], s[k])[0]) for k in range(depth, len(s)))
    for head_grams in (1 << 19, 50):
        got = by_id(suffix_tree.score_report(docs, head_grams=head_grams))
        assert all(r.score == pytest.approx(want[i], rel=1e-4) for i, r in got.items())


def test_tree_grows_with_the_corpus(spark):
    depth = suffix_tree.DEPTH
    texts = [b" ".join(t.encode().lower().split())[:400] for t in texts_of().values()]
    last = 0
    for times in (1, 20):
        counts, kept, prob = plain_tree(texts, depth, times)
        grams = [(int.from_bytes(c + bytes([b]), "big"), n, n) for c, own in counts.items() if len(c) == depth for b, n in own.items()]
        unseen = (int.from_bytes(b"zqzqzq!", "big"), 0, 1)
        rows = suffix_tree.grow(spark.createDataFrame([*grams, unseen], "gram long, n long, m long"), Scratch(spark, "t")).collect()
        assert len(rows) == len(grams) + 1
        for r in rows:
            history = r.gram.to_bytes(depth + 1, "big")
            q, order = prob(history[:-1], history[-1])
            assert r.order == order and r.logp == pytest.approx(np.log10(q), rel=1e-5)
        assert len(kept) > 1.5 * last
        last = len(kept)


# --- quality --------------------------------------------------------------------------------------------


def test_statistics(docs):
    labels = docs.sparkSession.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_report(docs, labels))
    for i, t in texts_of().items():
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        rep = len({k + j for k in range(len(words) - 4) if c[tuple(words[k : k + 5])] > 1 for j in range(5)})
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), rep), t[:50]
        assert r.base_failed == (len(words) < 10 or 100 * rep > 20 * len(words)) and r.kept == (r.rejected_by is None)


def test_binomial():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (200, 5, 0.05), (1000, 0, 0.004), (50, 49, 0.9)):
        assert quality.binomial_at_most(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_keep_the_risk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "a", float(v)) for i, v in enumerate(rng.random(4000) ** 3)] + [(9000 + i, "few", 0.5) for i in range(5)]
    values = spark.createDataFrame(rows, "doc_id long, lang string, ratio double")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    rule = quality.Rule("ratio", tuple(i / 50 for i in range(50, 0, -1)))
    cuts = {r.stratum: r.ratio for r in quality.choose_cutoffs(values, labels, rules=(rule,), risk=0.05).collect()}
    assert cuts["few"] is None
    over = sum(r[2] > cuts["a"] for r in rows if r[1] == "a") / 4000
    assert 0.02 < over <= 0.05
    strict = sum(r[2] > cuts["a"] - 0.02 for r in rows if r[1] == "a")
    assert quality.binomial_at_most(strict, 4000, 0.05) > 0.05 / 2


def test_rules_share_the_risk(spark):
    rules = tuple(quality.Rule(n, tuple(i / 50 for i in range(50, 0, -1))) for n in ("a", "b", "c", "d", "e"))
    rng = np.random.default_rng(4)
    rows = [(s * 10_000 + i, lang, *((rng.random(5) * 0.3).tolist() if n > 217 else [0.0] * 5)) for s, (lang, n) in enumerate((("x", 217), ("y", 216), ("z", 700), ("w", 6000))) for i in range(n)]
    values = spark.createDataFrame(rows, "doc_id long, lang string, a double, b double, c double, d double, e double")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    cuts = {r.stratum: r for r in quality.choose_cutoffs(values, labels, rules=rules).collect()}
    assert [cuts["y"][r.name] for r in rules] == [None] * 5
    assert [cuts["x"][r.name] for r in rules] == [0.02] * 5
    assert all(cuts[lang][r.name] <= 0.3 for lang in ("z", "w") for r in rules)
    for lang in ("z", "w"):
        own = [r[2:] for r in rows if r[1] == lang]
        hit = sum(any(v > cuts[lang][r.name] for v, r in zip(x, rules, strict=True)) for x in own)
        assert quality.binomial_at_most(hit, len(own), 0.02) <= 0.05 / 4


def test_kept_follows_plain_cutoffs(spark):
    """The whole report, with cutoffs at work, against a plain reading of the chains."""
    r, rng = random.Random(6), np.random.default_rng(6)
    words = ["alpha", "be", "gamma", "delta", "eps", "zeta", "eta", "iota", "kappa", "lambda"]

    def text(bad):
        out = [r.choice(words) + str(r.randrange(50)) for _ in range(r.randint(8, 90))]
        lines = [" ".join(out[i : i + 7]) for i in range(0, len(out), 7)]
        lines += [lines[0]] * int(rng.poisson(0.2 + 2 * bad))
        return "\n".join(lines) + "#" * int(rng.poisson(0.3 + 40 * bad))

    rows = [(i, text(i % 9 == 0), ["en", "de", "fr"][0 if i % 20 < 12 else 1 if i % 20 < 19 else 2], int(i % 9 != 0)) for i in range(1500)]
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3], 0) for x in rows if x[0] % 7], "doc_id long, quality int, toxic int")

    def values(t):
        own, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
        rep = len({k + j for k in range(len(own) - 4) if c[tuple(own[k : k + 5])] > 1 for j in range(5)})
        chars = sum(map(len, own))
        return [sum(ch in "#*$%&|<>" for ch in t) / chars, (len(lines) - len(set(lines))) / len(lines), rep / len(own), chars / len(own), -float(len(own))], len(own) < 10 or 100 * rep > 20 * len(own)

    told = {x[0]: values(x[1]) for x in rows}
    rules, cuts = quality.RULES, {}
    for lang in ("en", "de", "fr"):
        good = [told[x[0]][0] for x in rows if x[2] == lang and x[3] and x[0] % 7]
        blocks = max(k for k in range(len(good)) if k == 0 or quality.binomial_at_most(k - 1, len(good), quality.RISK) <= quality.LEVEL / 3)
        cut = [float("inf")] * 5
        for c in range(5):
            chain = [((c + j) % 5, s) for j in range(5) for s in rules[(c + j) % 5].steps]
            left = blocks // 5 + (c < blocks % 5)
            if left:
                places = sorted(next((i for i, (k, s) in enumerate(chain) if v[k] > s), len(chain)) for v in good)
                for k, s in chain[: places[left - 1]]:
                    cut[k] = min(cut[k], s)
        cuts[lang] = cut
    assert min(cuts["en"]) < float("inf") and cuts["fr"] == [float("inf")] * 5
    got = by_id(quality.quality_report(docs, labels))
    want = {x[0]: not told[x[0]][1] and all(v <= c for v, c in zip(told[x[0]][0], cuts[x[2]], strict=True)) for x in rows}
    assert {i: g.kept for i, g in got.items()} == want
    assert sum(not k and not told[i][1] for i, k in want.items()) > 20


# --- fingerprints ---------------------------------------------------------------------------------------


def slow_chunks(text):
    table = [int(x) for x in fingerprint.gear_table()]
    out, start = [], 0
    while start < len(text):
        end, most = None, min(start + 256, len(text))
        for i in range(start + 32, most):
            h = sum(table[text[i - 1 - j]] << j for j in range(32)) & 0xFFFFFFFF
            if h >> 24 == 0 if i - start < 64 else h >> 28 == 0:
                end = i
                break
        out.append(end or most)
        start = out[-1]
    return out


def test_chunks():
    texts = [t.encode() for t in list(texts_of().values())[:60] if len(t) < 5000]
    for text, ends in zip(texts, fingerprint.cut_points(texts, fingerprint.gear_table()), strict=True):
        assert ends == slow_chunks(text)


def test_fingerprints(docs):
    rows = [r for r in corpus() if r[0] not in (None, 3)]  # equal keys: any of their rows may follow
    got = by_id(fingerprint.fingerprint_report(docs.where("doc_id <> 3")))
    order = sorted(rows, key=lambda r: -r[0])
    table = fingerprint.gear_table()
    chunks = lambda t: fingerprint.chunk_sets([t.encode()], table)[0]
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = a[1] or "", b[1] or ""
        new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[a[0]]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprint.encode_set(chunks(t)) and r.edited_fingerprint == fingerprint.encode_set(chunks(new))
        assert (r.near_edited, r.near_next) == (fingerprint.containment(chunks(t), chunks(new)), fingerprint.containment(chunks(t), chunks(n)))
    assert fingerprint.fingerprint_report(docs).count() == docs.count()


# --- near-duplicates ------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    prints = list(prints)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_simhash(docs):
    got = by_id(simhash.near_duplicates(docs))
    prints = {i: slow_fingerprint(t) for i, t in texts_of().items()}
    comp = slow_components(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[comp[p]] = min(least.get(comp[p], i), i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", least[comp[p]]) for i, p in prints.items()}
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == slow_kept(texts_of()) and kept.columns == docs.columns


def slow_kept(texts):
    """The least key of each component by five-word shingles and two fingerprints."""
    prints = {i: slow_prints(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            (a, b), (c, d) = prints[i], prints[j]
            if (a ^ c).bit_count() <= 10 and (a ^ c).bit_count() + (b ^ d).bit_count() <= 22:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i in ids})


def slow_prints(text):
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).encode().split()
    shingles = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    first = [xxh64_intdigest(x, 42) for x in shingles]
    mask, second = (1 << 64) - 1, []
    for x in first:
        x = x + 43 * 0x9E3779B97F4A7C15 & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        second.append(x ^ x >> 31)
    return tuple(sum((sum(h >> k & 1 for h in hs) * 2 > len(hs)) << k for k in range(64)) for hs in (first, second))


def test_near_copies_of_five_word_shingles_go(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows, pairs = [], 0
    for i in range(120):
        words = [word() for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        for k in r.sample(range(200), i % 5):
            words[k] = word()
        rows.append((2 * i + 1, " ".join(words)))
        pairs += 1
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(120)} <= kept
    # the similarity of these pairs is 0.82 or more
    assert len(kept) - 120 <= 0.2 * pairs
    assert sorted(kept) == slow_kept(dict(rows))


def test_keep_one_tells_rows_of_one_key_apart(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, e), (3, d), (3, f), (3, f), (4, f), (None, ""), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame([(i, t, str(t)[:3]) for i, t in rows], "doc_id long, text string, lang string").repartition(3))
    assert kept.columns == ["doc_id", "text", "lang"]
    got = Counter((x.doc_id, x.text or "") for x in kept.collect())
    assert got == Counter([(None, a), (None, b), (1, c), (2, d), (2, e), (3, f), (None, "")])


@pytest.mark.parametrize("subtrie", [1_000_000, 7])
def test_trie_join_loses_no_link(spark, subtrie):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in prints[:80]:
        for n in (1, 3, 4, 5):
            q = p
            for b in rng.sample(range(64), n):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints + [0, 1, 3, 2**64 - 1]))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "__fp long")
    roots = {r.node: r.root for r in connected(simhash.links(nodes, subtrie=subtrie), Scratch(spark, "t")).collect()}
    comp = slow_components(prints)
    classes = lambda of: Counter(frozenset(v) for v in of.values())
    a, b = defaultdict(set), defaultdict(set)
    for p in prints:
        a[roots.get(signed(p), signed(p))].add(p)
        b[comp[p]].add(p)
    assert classes(a) == classes(b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 300)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(200, 300)}


# --- URLs -----------------------------------------------------------------------------------------------


def test_urls(spark):
    from plumbline.llm.queries import HOST_RULES

    cases = {
        "http://A.Example.com/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://x.com/en/1#y": ("x.com", "/en/1", "com/en/", "block"),
        "https://x.net/de/9": ("x.net", "/de/9", "net/de/", "allow"),
        "https://m.example.net/de/81": ("m.example.net", "/de/81", "example.net/de/8", "block"),
        "https://x.org/ES/": ("x.org", "/ES/", None, "allow"),
        "https://x.orgs/es/": ("x.orgs", "/es/", None, "allow"),
        "http://xcom/en/": ("xcom", "/en/", None, "allow"),
        "http://spam-farm.example.org/a": ("spam-farm.example.org", "/a", None, "block"),
        "http://spam-farm.example.com/en/7": ("spam-farm.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://a.b/x/casino/y": ("a.b", "/x/casino/y", None, "block"),
        "http://a.b/casinos/y": ("a.b", "/casinos/y", None, "allow"),
        "http://ads.b": ("ads.b", "", None, "block"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_verdicts(df, HOST_RULES() + url_filter.DEFAULT_RULES).collect()}
    assert got == dict(enumerate(cases.values()))


def test_index_finds_what_a_scan_finds():
    r = random.Random(2)
    parts = ["ads", "x1", "shop", "a-b", "img", "z"]
    loose = tuple(url_filter.Rule(p, "block", p) for p in ("ho", "-b", "ds-", "a-", "*mg*", "s*x", "hop"))
    rules = tuple(url_filter.Rule(r.choice(["||", "|http", "", "^", "*"]) + r.choice([".", "/", ""]).join(r.sample(parts, 2)) + r.choice(["^", "/", "*", "|", ""]), r.choice(["block", "allow"]), str(i), i) for i in range(60)) + loose
    matcher = url_filter.Matcher(rules, {"ads": 9, "x1": 1})
    tried = 0
    for _ in range(400):
        url = "http://" + ".".join(r.sample(parts, 2)) + "/" + "/".join(r.sample(parts, 3)) + r.choice(["", "?q=ads", "#x1"])
        *_, seen, rest = url_filter.split_url(url)
        hits = [x for x in rules if re.search(url_filter.compiled(x), rest if x.pattern.startswith("||") else seen, re.S)]
        best = max(hits, key=lambda x: (x.rank, x.action == "block", x.pattern), default=None)
        assert matcher.best(seen, rest) == best
        tried = matcher.tried
    assert tried < 400 * len(rules) and not matcher.rest


def test_every_default_rule_has_a_token(spark):
    assert not url_filter.Matcher(url_filter.DEFAULT_RULES, {}).rest
    assert url_filter.tokens_of(url_filter.Rule("spam-farm", "block")) == ["*spam", "farm*"]
    assert url_filter.tokens_of(url_filter.Rule("bet", "block")) == ["*bet*"] and url_filter.tokens_of(url_filter.Rule("/bet-x", "block")) == ["bet"]
    rules = (*url_filter.DEFAULT_RULES, url_filter.Rule("bet", "block"), url_filter.Rule("a1", "block"))
    urls = ["http://x.org/mySPAM-farms/casino-win", "http://bet.alphabet.org/bets-bet", "http://casino-x.org/casino/", "https://a1.b", None, "", "http://é.org/a1a1"] * 2
    wanted = {t for r in rules for t in url_filter.tokens_of(r)}
    plain = Counter()
    for u in urls:
        told = set(re.findall("[a-z0-9]+", (u or "").lower()))
        fits = {"**": lambda t, p: p in t, "*": lambda t, p: t.endswith(p), "_*": lambda t, p: t.startswith(p), "": lambda t, p: t == p}
        for w in wanted:
            kind = "**" if w[0] == w[-1] == "*" else "*" if w[0] == "*" else "_*" if w[-1] == "*" else ""
            plain[w] += any(fits[kind](t, w.strip("*")) for t in told)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert url_filter.token_counts(df, "url", rules) == +plain
    assert [r.verdict for r in url_filter.url_verdicts(df, rules).orderBy("page_id").collect()[:7]] == ["block", "block", "block", "block", "allow", "allow", "block"]


# --- BPE ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def test_bpe(docs, vocabulary):
    ranks, pattern = vocabulary
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    for r in bpe.bpe_tokens(docs, ranks, pattern).collect():
        if r.doc_id is None:
            continue
        t = texts_of()[r.doc_id]
        ids = plain.encode_ordinary(t)
        assert (r.n_tokens, r.token_ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_of_long_texts_in_parts(spark, vocabulary):
    r = random.Random(8)
    long = " ".join(r.choice(["word", "12", "é!", "\n", "naïve's"]) for _ in range(60_000))
    rows = [(1, long), (2, None), (3, ""), (4, " " * 200_000 + "x"), (5, long)]
    got = {r.doc_id: r for r in bpe.bpe_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), *vocabulary).collect()}
    plain = bpe.load_encoding(*vocabulary)
    for i, t in rows:
        ids = plain.encode_ordinary(t or "") if i != 4 else got[4].token_ids
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_cuts_change_nothing(vocabulary):
    ranks, pattern = vocabulary
    encoding = bpe.load_encoding(ranks, pattern)
    r = random.Random(4)
    for _ in range(60):
        t = "".join(r.choice(["word", " ", "  ", "\n", "12", "'s", "é", "!!", "\x1c", " ", "　"]) for _ in range(r.randint(0, 300)))
        assert bpe.encode(encoding, pattern, t, limit=20) == encoding.encode_ordinary(t)
    assert encoding.decode_bytes(bpe.encode(encoding, pattern, " " * 2_000_000 + "x")) == b" " * 2_000_000 + b"x"


# --- languages ------------------------------------------------------------------------------------------


def invented(r, parts, n):
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    r = random.Random(6)
    kinds = {"aa": ["tho", "ing", "wha"], "bb": ["ció", "nar", "que"], "cc": ["sch", "ung", "ver"]}
    rows = [(i, invented(r, kinds[k], r.randint(5, 90)), k) for i, k in enumerate(list(kinds) * 60)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (None, "tho ing", None), (1003, invented(r, kinds["aa"], 40) + " " + invented(r, kinds["bb"], 200), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    got = by_id(language.label_languages(df, model))
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows[:180])
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "bb" and got[1003].score < 0.95
    none = language.label_languages(df, language.train(df.where("lang IS NULL")))
    assert {x.lang_pred for x in none.collect()} == {"und"}


def test_chain_runs_over_the_whole_text():
    rng = np.random.default_rng(3)
    k, step = 3, 4
    moves = rng.normal(size=(k, k))
    sizes = [1, 4, 5, 11, 8]
    chains = [rng.normal(size=(n, k)) for n in sizes]
    pieces = [-(-n // step) for n in sizes]
    grid, mask = np.zeros((step, sum(pieces), k)), np.zeros((step, sum(pieces)), bool)
    nth, of, col = [], [], 0
    for c, m in zip(chains, pieces, strict=True):
        for i, x in enumerate(c):
            grid[i % step, col + i // step], mask[i % step, col + i // step] = x, True
        nth += range(m)
        of += [m] * m
        col += m
    got, col = language.marginals(grid, mask, moves, np.array(nth), np.array(of)), 0
    for c, m in zip(chains, pieces, strict=True):
        want, _ = language.forward_backward(c[:, None, :], np.ones((len(c), 1), bool), moves)
        for i in range(len(c)):
            assert np.allclose(got[i % step, col + i // step], want[i, 0])
        col += m


def test_words_of_code_switched_texts_are_labelled(spark):
    words = {"aa": ["nora", "pell", "quim"], "bb": ["stov", "trig", "uxal"]}
    rng = np.random.default_rng(1)
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, text(x, 30), x) for i, x in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame([*rows, (100, text("aa", 70) + " " + text("bb", 80), None), (101, None, None), (102, "12 ++", "aa")], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = by_id(language.label_words(docs, model, keep=["doc_id"]))
    assert [(p.lang, p.first, p.words) for p in got[100].passages] == [("aa", 0, 70), ("bb", 70, 80)]
    assert all(p.score > 0.8 for p in got[100].passages)
    assert got[101].passages == [] and got[102].passages == []
    assert all([(p.lang, p.words) for p in got[i].passages] == [(x, 30)] for i, _, x in rows)


def test_training_sample_is_whole_and_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w" * (i % 50 + 1), f"l{i % 3}") for i in range(600)] + [(900, "x" * 5000, "l0"), (901, None, "l1"), (902, "y", None)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "SAMPLE_DOCS", 20)
    got = language.training_sample(docs)
    assert Counter(x for x, _ in got) == {"l0": 20, "l1": 20, "l2": 20} and got == language.training_sample(docs)
    assert max(len(t) for _, t in got) <= 5000
    monkeypatch.setattr(language, "SAMPLE_CHARS", 400)
    sizes = Counter()
    for x, t in language.training_sample(docs):
        sizes[x] += len(t)
    assert all(300 < n <= 400 for n in sizes.values())
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language.training_sample(docs)


def test_forward_backward():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    post, pairs = language.forward_backward(scores, mask, moves)
    total = np.zeros((3, 3))
    for s, n in enumerate((4, 2)):
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        w = np.array([np.exp(sum(scores[i, s, p[i]] for i in range(n)) + sum(moves[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        w /= w.sum()
        for i in range(n):
            assert np.allclose(post[i, s], [w[paths[:, i] == k].sum() for k in range(3)])
        for p, x in zip(paths, w, strict=True):
            for i in range(n - 1):
                total[p[i], p[i + 1]] += x
    assert np.allclose(pairs, total)
    assert np.allclose(language.marginals(scores, mask, moves)[mask], post[mask])


# --- mixing ---------------------------------------------------------------------------------------------


def test_water_fill():
    out = mixing.water_fill([100, 10, 50], [3, 1, 2], 240, 2)
    assert sum(out) == 240 and all(x <= 2 * s for x, s in zip(out, [100, 10, 50], strict=True))
    assert out[1] == 20 and out[0] / 3 == out[2] / 2 or out[2] == 100


def test_flow_prefers_first_copies():
    got = mixing.route([(("a",), 10), (("a", "b"), 10), (("b",), 10)], {"a": 15, "b": 30}, 2)
    assert sum(f for way in got for s, f in way if s == "a") == 15 and sum(f for way in got for s, f in way if s == "b") == 30
    assert all(sum(f for _, f in way) <= 20 for way in got) and sum(max(0, sum(f for _, f in way) - 10) for way in got) == 15


def test_flow_is_cheapest():
    """Against all ways to route the words of small instances: as much as can be routed, at the least cost."""
    from itertools import product

    r = random.Random(9)
    for _ in range(60):
        names = ["a", "b", "c"][: r.randint(1, 3)]
        patterns = [(tuple(r.sample(names, r.randint(1, len(names)))), r.randint(0, 2)) for _ in range(r.randint(1, 3))]
        quotas, times = {s: r.randint(0, 5) for s in names}, r.randint(1, 3)
        ways = [[w for w in product(range(times * n + 1), repeat=len(sources)) if sum(w) <= times * n] for sources, n in patterns]
        cost = lambda f, n: sum(copy * max(0, min(f - copy * n, n)) for copy in range(times))
        best = (0, 0)
        for way in product(*ways):
            into = Counter()
            for (sources, _), w in zip(patterns, way, strict=True):
                into.update(dict(zip(sources, w, strict=True)))
            if all(into[s] <= q for s, q in quotas.items()):
                best = min(best, (-sum(into.values()), sum(cost(sum(w), n) for (_, n), w in zip(patterns, way, strict=True))))
        got = mixing.route(patterns, quotas, times)
        into = Counter()
        for way, (_, n) in zip(got, patterns, strict=True):
            into.update(dict(way))
            assert sum(f for _, f in way) <= times * n
        assert all(into[s] <= q for s, q in quotas.items())
        assert (-sum(into.values()), sum(cost(sum(f for _, f in way), n) for way, (_, n) in zip(got, patterns, strict=True))) == best


def test_taken_follows_the_flow_in_hash_order(docs):
    """The whole report against a plain one: targets, then each copy up to the document nearest to the flow's end."""
    ordered = docs.select("doc_id", "text", "source", mixing.order_of(17, "doc_id", "text").alias("at")).collect()
    sized = [(r.source, r.at, len(WORD.findall(r.text or "")), r.doc_id) for r in ordered]
    size = Counter()
    for s, _, n, _ in sized:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.water_fill([size[s] for s in names], [3, 1, 2], mixing.Fraction(3, 2) * sum(size.values()), 2), strict=True))
    want = Counter()
    for s in names:
        own, upto = sorted((r for r in sized if r[0] == s), key=lambda r: r[1]), round(targets[s])
        copies = Counter()
        for copy in range(2):
            before, cut = 0, None
            for _, at, n, _ in own:
                if cut is None and before + n / 2 + copy * size[s] > upto:
                    cut = at
                before += n
            copies.update({i: 1 for i, r in enumerate(own) if r[2] and (cut is None or r[1] < cut)})
        want.update((r[3], r[2], size[s], round(float(targets[s]), 6), copies[i] * r[2]) for i, r in enumerate(own))
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_report(docs).collect())
    assert got == want


def test_mix(docs):
    rows = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs).collect()
    assert Counter(rows) == Counter(again) and len(rows) == docs.count()
    size = Counter()
    for r in corpus():
        size[r[3]] += len(WORD.findall(r[1] or ""))
    largest = max(len(WORD.findall(r[1] or "")) for r in corpus())
    taken, target = Counter(), {}
    ids = {r[0]: r[3] for r in corpus() if r[0] is not None}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        if r.doc_id is not None:
            s = ids[r.doc_id]
            assert r.source_size == size[s]
            taken[s] += r.taken
            target[s] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - t) <= largest for s, t in target.items())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_mix_overlapping(spark):
    df = spark.createDataFrame([(i, "w " * 10, [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(80)], "doc_id long, text string, source array<string>")
    rows = mixing.mix_report(df).collect()
    assert sum(r.taken for r in rows) == pytest.approx(1200, abs=30) and all(r.taken <= 20 for r in rows)


# --- WARC -----------------------------------------------------------------------------------------------


def test_warc(spark):
    big, r = "<p>" + "é" * 1500, random.Random(1)
    rows = [(i, f"http://h/{i} x\n", h) for i, h in enumerate([big, "a", "a", None, big, "", big] + ["".join(r.choice("abc ") for _ in range(2000)) for _ in range(30)])]
    rows += [(6, "http://again", big), (None, None, big), (None, None, "c" * 2000)]
    pages = spark.createDataFrame([(*x, "z") for x in rows], "page_id long, url string, html string, digest string").repartition(3)
    scratch = Scratch(spark, "warc")
    manifest = warc.write_warc(pages, scratch)
    got = Counter(tuple(x)[:5] for x in warc.read_warc(manifest).collect())
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == p and j is not None] if len(p) >= 1000 else []
        first = max(same, default=None)
        revisit = first is not None and first != i
        want[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want
    names, refers = Counter(), set()
    for r in manifest.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            assert f.read(4) == bytes.fromhex("5D2A4D18")
            f.seek(0)
            for raw in warc.read_archive(f):
                fields = warc.parse(raw)[0]
                names[fields["WARC-Record-ID"]] += 1
                refers.add(fields.get("WARC-Refers-To"))
    # only rows equal in page_id and payload share a name; revisits name records that exist
    assert sorted(names.values()) == sorted(Counter((i, h or "") for i, _, h in rows).values())
    assert refers - {None} and refers - {None} <= set(names)


# --- empty tables ---------------------------------------------------------------------------------------


def test_empty(spark, docs, vocabulary):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        substring_dedup.dedup_report(none),
        substring_dedup.dedup_texts(none),
        suffix_tree.score_report(none),
        quality.quality_report(none, labels),
        fingerprint.fingerprint_report(none),
        simhash.near_duplicates(none),
        bpe.bpe_tokens(none, *vocabulary),
        language.label_languages(none, language.train(none)),
        mixing.mix_report(none),
        mixing.mix_documents(none),
        url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")),
        warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark, "w"))),
    ):
        assert df.count() == 0
    assert quality.quality_report(docs, labels).where("rejected_by NOT IN ('base')").count() == 0
    assert F.lit(1) is not None


def test_each_gram_of_a_line_is_looked_up_once(monkeypatch):
    sizes, found = [], np.searchsorted

    def counting(a, v, *how):
        sizes.append(np.size(v))
        return found(a, v, *how)

    lines = [b"ab" * 5000, b"", b"xyz"]
    keys = np.unique(suffix_tree.grams_of(lines[:2], 6))
    monkeypatch.setattr(suffix_tree.np, "searchsorted", counting)
    score, odd = suffix_tree.score_grams(lines, keys, np.full(len(keys), -1.0, np.float32), 6)
    assert score.tolist() == [-10001.0, -1.0, 0.0] and [len(x) for x in odd.to_pylist()] == [0, 0, 4]
    assert max(sizes) < 50


def test_workers_give_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def run(batches):
        for n in batches:
            held = [bytes(1000 + i % 100) for i in range(n)]
            pin = bytes(2000)
            del held
            yield pin

    before = resident()
    pins = list(slim(run)([200_000]))
    assert len(pins) == 1 and resident() - before < 50 << 20
