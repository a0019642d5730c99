"""Pair metrics against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagescale.operators import metrics as M


def bleu(ref, hyp):
    if not hyp:
        return 0.0
    logs = []
    for n in range(1, 5):
        h = Counter(tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1))
        r = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        hit = sum(min(c, r[g]) for g, c in h.items())
        if n == 1 and hit == 0:
            return 0.0
        logs.append(math.log(max(hit / max(len(hyp) - n + 1, 1), 1e-300)))
    brevity = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(sum(logs) / 4)


def meteor(ref, hyp):
    ref, hyp = [t.lower() for t in ref], [t.lower() for t in hyp]
    left_r, pairs = list(enumerate(ref)), []
    for i in range(len(hyp) - 1, -1, -1):
        for j in range(len(left_r) - 1, -1, -1):
            if left_r[j][1] == hyp[i]:
                pairs.append((i, left_r.pop(j)[0]))
                break
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(1 for a, b in zip(pairs, pairs[1:]) if (b[0], b[1]) != (a[0] + 1, a[1] + 1))
    m = len(pairs)
    p, r = m / len(hyp), m / len(ref)
    return (1 - 0.5 * (chunks / m) ** 3) * p * r / (0.9 * p + 0.1 * r)


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(1)
    rows = [("e0", "", ""), ("e1", "a b", ""), ("e2", "", "a b"), ("e3", "a b c d e", "a b c d e"), ("e4", "a", "b"), ("e5", "a b c", "a b c"), ("e6", "頁a 頁", "頁 b")]
    for i in range(80):
        g = [rnd.choice("abcdeFf") for _ in range(rnd.randint(0, 14))]
        p = [t if rnd.random() < 0.7 else rnd.choice("abcdeF") for t in g][: rnd.randint(0, 14)]
        rows.append((f"r{i}", " ".join(p), " ".join(g)))
    return spark.createDataFrame(rows, "id string, prediction string, ground_truth string")


def test_bleu_and_meteor(pairs):
    toks = M.tokenize(pairs)
    text = {r.id: (list(r.ref), list(r.hyp)) for r in toks.collect()}
    assert text["e6"] == (["頁", "b"], ["頁", "a", "頁"])
    for r in M.bleu4(toks).collect():
        assert r.bleu == pytest.approx(bleu(*text[r.id]), abs=1e-12), r.id
    for r in M.meteor_exact(toks).collect():
        assert r.meteor == pytest.approx(meteor(*text[r.id]), abs=1e-12), r.id


def test_scores_edges_and_roles(pairs):
    out = {r.id: r for r in M.score_pairs(pairs).collect()}
    assert len(out) == pairs.count()
    assert out["e0"].edit_dist == 0.0 and out["e0"].precision is None and out["e0"].f_measure is None
    assert out["e2"].precision is None and out["e2"].recall == 0.0
    assert out["e3"].f_measure == 1.0 and out["e3"].bleu == pytest.approx(1.0)
    assert out["e4"].f_measure == 0.0
    swapped = {r.id: r for r in M.score_pairs(pairs, swap_roles=True).collect()}
    for i, r in out.items():
        assert swapped[i].precision == r.recall and swapped[i].recall == r.precision and swapped[i].edit_dist == r.edit_dist
        for v in (r.bleu, r.precision, r.recall, r.f_measure, r.edit_dist):
            assert v is None or -1e-12 <= v <= 1 + 1e-12


def test_mean_by(pairs):
    row = M.mean_metrics(M.score_pairs(pairs)).first()
    assert row.n == pairs.count()
    ref = M.score_pairs(pairs).agg(F.avg("edit_dist").alias("e")).first().e
    assert row.edit_dist == pytest.approx(ref)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bleu_makes_no_row_a_gram(pairs):
    """every gram was a row that moved into an aggregate."""
    toks = M.tokenize(pairs)
    for df in (M.bleu4(toks), M.score_pairs(pairs), M.score_pairs(pairs, swap_roles=True)):
        assert "Generate" not in _plan(df) and "Join" not in _plan(df)


def test_bleu_of_repeated_ids_counts_their_grams_together(spark):
    rows = [("a", "x y z w v", "x y z w u"), ("b", "x y", "x y"), ("b", "x y", "x q"), (None, "x", "x"), (None, "q", "x"), ("c", "x", "x")]
    df = spark.createDataFrame(rows, "id string, prediction string, ground_truth string")
    toks = M.tokenize(df)
    got = {r.id: r.bleu for r in M.bleu4(toks).collect()}
    assert got == {r.id: pytest.approx(r.bleu) for r in M._pooled_bleu(toks.select("id", "ref", "hyp")).collect()} and len(got) == 4
    out = M.score_pairs(df).collect()
    assert sorted(r.id for r in out) == ["a", "b", "b", "c"] and all(r.bleu == pytest.approx(got[r.id]) for r in out)
