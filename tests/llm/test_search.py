"""Top-k search, collocations and ranked lexical search against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagescale.llm import collocations, dual_tree, topk_search
from pagescale.llm.common import word_slices
from pagescale.llm.quotient_filter import Filter, permuted, restored

# --- top-k --------------------------------------------------------------------------------------------------------


def brute_top(rows, every, k):
    units = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q, a in units:
        if q is None or q % every:
            continue
        found = sorted((-dot(a, b), i is None, i or 0, i) for i, b in units if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(found, start=1)]
    return sorted(out, key=str)


def top(spark, rows, every=5, k=3, **options):
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, RANK string")
    return sorted(map(tuple, topk_search.top_k(table, "vec_id", "embedding", every, k, **options).collect()), key=str)


@pytest.mark.parametrize("n_lists", [1, 2, 3])
def test_top_k_equals_brute_force(spark, n_lists):
    rng = np.random.default_rng(n_lists)
    centres = rng.normal(size=(4, 7))
    rows = [(i, [float(x) for x in centres[i % 4] + 0.4 * rng.normal(size=7)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # a group of copies, with queries in it
    assert top(spark, rows, n_lists=n_lists) == brute_top(rows, 5, 3)


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [-1.0, 0.25]), (5, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [2.0, 2.0])]
    rows += [(10, []), (6, [0.001, -0.001]), (7, [1.0]), (15, [0.0, 0.0]), (20, [-3.0, -3.0]), (21, [1.0, 0.5])]
    assert top(spark, rows) == brute_top(rows, 5, 3)
    assert top(spark, rows, k=50) == brute_top(rows, 5, 50)  # fewer than k
    assert top(spark, [(5, [1.0])]) == [] and top(spark, []) == [] and top(spark, [(1, [1.0]), (2, [1.0])]) == []
    with pytest.raises(ValueError):
        top(spark, [(5, [1e12, 1e12]), (6, [1.0, 1.0])])


def test_top_k_in_blocks_and_large_units(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-(2**22), 2**22, 4)]) for i in range(60)]  # over 2**53: whole numbers
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    assert top(spark, rows) == brute_top(rows, 5, 3)


# --- collocations -------------------------------------------------------------------------------------------------


def test_filter_round_trip():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3)]
    assert all((a == b).all() for a, b in zip(restored(permuted(words)), words))
    for n in (2, 3):
        own = Filter.of([x % np.uint64(40) for x in words[:n]], rng.integers(1, 600, 500))
        for bits in (1, 3, 9):
            back = [(b, Filter.unpacked(f.packed(bits), b, bits), f) for b, f in own.buckets(bits)]
            assert sum(len(f) for _, f, _ in back) == len(own)
            for _, f, g in back:
                assert (f.counts == g.counts).all() and all((a == b).all() for a, b in zip(f.keys, g.keys))
    many = [Filter.counted([x[:300] % np.uint64(6) for x in words[:2]]), Filter.counted([x[200:] % np.uint64(6) for x in words[:2]])]
    got = Filter.merged(many)
    want = Counter([tuple(int(x[i] % np.uint64(6)) for x in words[:2]) for i in [*range(300), *range(200, 500)]])
    assert Counter(dict(zip(zip(*[k.tolist() for k in restored(got.keys)]), got.counts.tolist()))) == want


def brute_phrases(rows, top=2000, least=10, percent=50):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in (1, 2, 3):
                counts[lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, c in counts.items():
        kept = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            s, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((-s, -a, " ".join(p).encode(), left, right))
        for r, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], start=1):
            out.append((lang, r, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def phrases(spark, rows, **options):
    table = spark.createDataFrame([(lang, text, 1, "w") for lang, text in rows], "lang string, text string, n int, phrase string")
    return sorted(map(tuple, collocations.collocations(table, **options).collect()))


def some_texts(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "New", "york", "city", "é", "日本", "a-b", "x", "\x00y"]
    return [(rnd.choice(["en", "en", "de", None]), "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "!"]) for _ in range(rnd.randrange(40)))) for _ in range(n)]


def test_collocations_equal_brute_force(spark):
    rows = some_texts(3) + [("en", None), ("en", ""), (None, "..!\n"), ("fr", "un deux")] + [("en", "the new york city. of the new york city")] * 20
    assert phrases(spark, rows) == brute_phrases(rows)
    assert phrases(spark, rows, top=3) == brute_phrases(rows, top=3)
    assert phrases(spark, []) == [] and phrases(spark, [(None, None)]) == []


def test_collocations_over_slices_and_flushes(spark, monkeypatch):
    rows = some_texts(5, 25) + [("en", "new york city the of " * 300), ("en", "a" * 500 + " new york " * 40)]
    monkeypatch.setattr(collocations, "HELD_KEYS", 40)
    monkeypatch.setattr(collocations, "HELD_WORDS", 5)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 16)
    monkeypatch.setattr(collocations, "word_slices", lambda data: word_slices(data, 64))
    assert phrases(spark, rows) == brute_phrases(rows)


def test_words_with_one_id_get_others(spark, monkeypatch):
    rows = some_texts(7, 40)
    real = collocations.xxhash.xxh64_intdigest

    class Weak:
        @staticmethod
        def xxh64_intdigest(data, seed=0):
            return real(data, seed) if seed or data in (b"en", b"de", b"und") else len(data)

    monkeypatch.setattr(collocations, "xxhash", Weak)
    assert phrases(spark, rows) == brute_phrases(rows)


def test_slices_lose_nothing():
    data = b"ab  cde f " * 50 + b"z" * 90 + b" end"
    for size in (1, 7, 64, 10_000):
        assert [w for s in word_slices(data, size) for w in s] == data.split()
    assert list(word_slices(b"")) == []


# --- ranked search ------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    n_docs, n_words = len(own), sum(n for _, _, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in own:
            m = 50 + (50 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], start=1)]
    return sorted(out, key=str)


def ranks(spark, docs, items, k=50):
    d = spark.createDataFrame([(i, t, 3, "a") for i, t in docs], "doc_id long, text string, n int, terms string")
    q = spark.createDataFrame([(i, t, 1.5) for i, t in items], "item_id long, text string, score double")
    return sorted(map(tuple, dual_tree.ranked(d, q, k=k).collect()), key=str)


def lexical(seed, n, words):
    rnd = random.Random(seed)
    return [(i, " ".join(f"w{min(int(rnd.paretovariate(0.6)), words)}" for _ in range(rnd.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranked_search_equals_brute_force(spark, k):
    docs, items = lexical(1, 700, 400), lexical(2, 45, 400)
    assert ranks(spark, docs, items, k) == brute_ranks(docs, items, k)


def test_ranked_search_of_odd_rows(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "..!"), (None, "Alpha beta"), (4, "alpha ALPHA béta"), (4, "alpha ALPHA béta"), (5, "x_y alpha"), (6, "É é 日本"), (7, "alpha beta " * 3000), (8, "beta")]
    docs += [(100 + i, "same words here") for i in range(80)]
    items = [(1, "alpha, beta?"), (1, "alpha, beta?"), (None, "日本 é"), (2, None), (3, "--"), (4, "absent"), (5, "same"), (6, "x y ALPHA here")]
    assert ranks(spark, docs, items) == brute_ranks(docs, items, 50)
    assert ranks(spark, docs, []) == [] and ranks(spark, [], items) == [] and ranks(spark, [(1, None)], items) == []
    monkeypatch.setattr(dual_tree, "BLOCK_CHARS", 12)  # several blocks of items
    monkeypatch.setattr(dual_tree, "TREE_ENTRIES", 5)
    assert ranks(spark, docs, items, 7) == brute_ranks(docs, items, 7)


def test_tree_bounds_hold():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 9, 203)
    rows = dual_tree.Rows(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.sort(rng.choice(30, s, replace=False)) for s in sizes]), rng.integers(1, 100, sizes.sum()))
    tree = dual_tree.Tree(rows, 30, 16)
    assert sorted(tree.order) == list(range(203)) and len(tree.levels) > 2
    query = rng.integers(0, 2, 30)
    scores = rows.times(tree.order, query)
    below = np.arange(203)
    for level in range(1, len(tree.levels)):
        nodes = np.arange(len(tree.levels[level]))
        bound = tree.levels[level].times(nodes, query)
        span = 16 * dual_tree.FAN ** (level - 1)
        assert all(bound[n] >= scores[n * span : (n + 1) * span].max() for n in nodes)
        assert (tree.children(level, nodes) == np.arange(len(tree.levels[level - 1]))).all()
    assert len(below) == 203
