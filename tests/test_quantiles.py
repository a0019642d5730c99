"""Exact quantiles, hash ranks, intervals and neighbours against numpy and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagescale.operators import windows as W
from pagescale.operators.neighbours import kth_neighbour, trim_sparse
from pagescale.operators.quantiles import exact_quantiles, hash_rank, order_key


def test_quantiles_small_and_large_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": np.round(rng.beta(0.4, 3, 4000), 3), "flat": np.full(700, 0.25), "tiny": rng.random(5), "one": np.array([0.7])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("tiny", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    for digit in (16, 5):  # short digits take more passes
        got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, digit=digit).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k].n == len(vs)
            for name, p in probs.items():
                assert got[k][name] == pytest.approx(np.quantile(vs, p), abs=1e-12), (k, name, digit)
    allv = np.concatenate(list(groups.values()))
    for digit in (16, 5):
        row = exact_quantiles(df, [], "v", {"m": 0.3}, digit=digit).collect()
        assert len(row) == 1 and row[0].m == pytest.approx(np.quantile(allv, 0.3), abs=1e-12)


def test_order_key_orders_all_doubles(spark):
    rng = np.random.default_rng(3)
    edge = [0.0, -0.0, 1.0, 2.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 0.1, 4503599627370497.5]
    edge += [float(np.nextafter(x, y)) for x in (1.0, 2.0, 8.0, 1024.0, 2.0**-7, 2.0**600) for y in (0, np.inf)]
    values = sorted([*edge, *(-x for x in edge), *(rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300))])
    got = [r.k for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(order_key(F.col("v")).alias("k"), "v").sort("v").collect()]
    bits = lambda v: int(np.float64(abs(v)).view(np.int64)) * (-1 if v < 0 else 1)
    assert got == [bits(v) for v in values]
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(order_key(F.col("v")).alias("k")).first().k
    assert nan > max(got)


def test_quantiles_of_odd_values_and_keys(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, 1, x) for x in (3.0, 1.0, None)] + [("a", None, x) for x in (nan, 1.0, 2.0)] + [("a", 2, x) for x in (-inf, inf, inf, inf)] + [("b", 1, None), ("z", 0, -0.0), ("z", 0, 0.0)]
    rows += [("near", 1, 1.0 + i * 2.0**-52) for i in range(40)] + [("neg", 1, -float(i)) for i in range(100)]
    out = exact_quantiles(spark.createDataFrame(rows, "g string, h int, v double"), ["g", "h"], "v", {"lo": 0.0, "mid": 0.5, "p": 0.3, "hi": 1.0})
    got = {(r.g, r.h): r for r in out.collect()}
    assert set(got) == {(None, 1), ("a", None), ("a", 2), ("z", 0), ("near", 1), ("neg", 1)}
    assert (got[None, 1].mid, got[None, 1].n) == (2.0, 2) and got["a", None].lo == 1.0 and got["a", None].mid == 2.0 and np.isnan(got["a", None].hi)
    assert got["a", 2].lo == -inf and got["a", 2].mid == got["a", 2].hi == inf and got["z", 0].mid == 0.0
    near, neg = [r[2] for r in rows if r[0] == "near"], [r[2] for r in rows if r[0] == "neg"]
    assert got["near", 1].p == pytest.approx(np.quantile(near, 0.3), abs=2.0**-52) and got["neg", 1].p == pytest.approx(np.quantile(neg, 0.3))
    assert exact_quantiles(spark.createDataFrame([], "v double"), [], "v", {"q": 0.5}).count() == 0


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(5000)
    a = {r.id: r["rank"] for r in hash_rank(df, ["id"], 3).collect()}
    b = {r.id: r["rank"] for r in hash_rank(df.repartition(7), ["id"], 3).collect()}
    c = {r.id: r["rank"] for r in hash_rank(df, ["id"], 4).collect()}
    assert sorted(a.values()) == list(range(5000)) and a == b and a != c


def loop_interval(diff, first, width, left, right):
    roll = [np.mean(diff[max(0, i - 2) : i + 3]) for i in range(len(diff))]
    peak = int(np.argmax(roll))
    lo, start = (first + 1) * width, peak
    while True:
        hit = next((i for i in range(start, 1, -1) if all(v < left for v in roll[i - 2 : i + 1])), None)
        if hit is None:
            break
        lo = (first + hit + 1) * width
        loud = [j for j in range(hit) if roll[j] > 0.15]
        if not loud:
            break
        start = loud[-1]
    hi = (first + len(roll) - 1) * width + width / 2
    for i in range(peak, len(roll) - 2):
        if all(v < right for v in roll[i : i + 3]):
            hi = (first + i) * width + width / 2
            break
    return lo, hi


def test_interval_matches_loop(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for g in range(60):
        n, first = rnd.randint(1, 25), rnd.randint(0, 6)
        level, diff = rnd.random() * 0.4, []
        for _ in range(n):
            level = min(0.9, max(0.0, level + rnd.uniform(-0.2, 0.2)))
            diff.append(0.0 if rnd.random() < 0.15 else round(level, 3))
        diff[0], diff[-1] = diff[0] or 0.001, diff[-1] or 0.001  # the outer bins hold points
        for b, d in enumerate(diff):
            if d:  # ten points whose 10 % and 90 % quantiles differ by d
                rows += [(g, (first + b) * 100 + 10 + j, d * j / 9 / 0.8) for j in range(10)]
        want[g] = loop_interval(diff, first, 100, 0.1, 0.3)
    df = spark.createDataFrame(rows, "g int, text_len int, edit_distance double")
    got = {r.g: (r.L, r.R) for r in W.variance_interval(df, ["g"]).collect()}
    for g, w in want.items():
        assert got[g] == pytest.approx(w), g


def test_interval_needs_ten_points(spark):
    df = spark.createDataFrame([(1, 100 * i, 0.1) for i in range(1, 10)], "g int, text_len int, edit_distance double")
    row = W.variance_interval(df, ["g"]).first()
    assert row.L is None and row.R is None


def test_drop_top_n_small_groups_and_ties(spark):
    rows = [(512, 28, 6, 0, f"i{i}", 0.5) for i in range(8)] + [(640, 28, 6, 0, f"j{i}", i / 10) for i in range(4)] + [(99, 28, 6, 0, "k", 0.1)]
    df = spark.createDataFrame(rows, "resolution int, font_size int, line_spacing int, letter_spacing int, image_id string, edit_distance double")
    kept = {r.image_id for r in W.drop_top_n(df).collect()}
    assert kept == {"i0", "i1", "i2", "k"}


@pytest.mark.parametrize("leaf", [1, 8])
def test_kth_neighbour(spark, leaf):
    rng = np.random.default_rng(2)
    clouds = {
        "mixed": np.vstack([rng.normal(0, 0.01, (150, 2)), rng.normal(3, 1.0, (60, 2)), np.repeat([[1.0, 1.0]], 40, axis=0), [[9.0, -9.0]]]),
        "line": np.column_stack([np.linspace(0, 1, 80), np.zeros(80)]),
        "few": rng.random((4, 2)),
        "same": np.repeat([[2.0, 2.0]], 30, axis=0),
    }
    rows = [(g, float(x), float(y)) for g, pts in clouds.items() for x, y in pts]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    k = 5
    got = {(r.g, r.x, r.y): r.dk for r in kth_neighbour(df, ["g"], k, leaf=leaf).collect()}
    for g, pts in clouds.items():
        for x, y in pts:
            if len(pts) <= k:
                assert (g, float(x), float(y)) not in got
                continue
            d = np.sort(np.hypot(pts[:, 0] - x, pts[:, 1] - y))[k]
            assert got[(g, float(x), float(y))] == pytest.approx(d, abs=1e-12), g


@pytest.mark.parametrize("block", [24, 70])
def test_kth_neighbour_across_blocks(spark, block):
    """groups are cut into blocks; circles that leave a block are answered by the blocks they meet."""
    rng = np.random.default_rng(4)
    clouds = {
        "mixed": np.vstack([rng.normal(0, 0.01, (200, 2)), rng.normal(3, 1.0, (150, 2)), np.repeat([[1.0, 1.0]], 90, axis=0), [[90.0, -90.0]]]),
        "grid": np.array([(i, j) for i in range(17) for j in range(17)], dtype=float),
        "line": np.column_stack([np.zeros(300), np.linspace(0, 1, 300) ** 3]),
        "few": rng.random((5, 2)), "next": rng.random((6, 2)), "same": np.repeat([[2.0, 2.0]], 130, axis=0),
    }
    rows = [(g, float(x), float(y)) for g, pts in clouds.items() for x, y in pts]
    odd = [(None, 0.0, 0.0), ("grid", None, 1.0), ("grid", 1.0, None), ("few", float("inf"), 0.0), ("few", 0.0, float("nan"))]
    k = 5
    got = {(r.g, r.x, r.y): r.dk for r in kth_neighbour(spark.createDataFrame(rows + odd, "g string, x double, y double"), ["g"], k, block=block).collect()}
    want = {}
    for g, pts in clouds.items():
        for x, y in pts if len(pts) > k else []:
            want[g, float(x), float(y)] = np.sort(np.sqrt((pts[:, 0] - x) ** 2 + (pts[:, 1] - y) ** 2))[k]
    assert got == want


def test_trim_writes_no_more_than_its_points(spark, monkeypatch):
    """candidate cells of every position were written level by level, many times the points; now each row once and the few at rims."""
    from pagescale.operators import neighbours

    written, write = {}, neighbours.cut_lineage
    def counted(df, name="step"):  # noqa: E306
        out = write(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(neighbours, "cut_lineage", counted)
    n = 6_000
    rng = np.random.default_rng(7)
    rows = [(512, 28, 6, 0, i % 50, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (n, 2)))]
    df = spark.createDataFrame(rows, "resolution int, font_size int, line_spacing int, letter_spacing int, image_id int, x double, y double")
    assert trim_sparse(df, block=1_500).count() == 0.95 * n
    assert sum(written.values()) < 1.5 * n


def test_radix_keys_are_not_filtered_on(spark):
    """a join of the keyed rows computed the key a second time, written out as one long expression, to test it for NULL."""
    from pagescale.operators.quantiles import _keyed

    rows = spark.createDataFrame([(1.0,), (None,)], "_v double")
    plan = _keyed(rows).join(spark.createDataFrame([(3,)], "p long"), F.shiftright("_key", 42) == F.col("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "POWER" in line]


def test_trim_drops_the_sparse_share(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(0, 0.1, (190, 2)), rng.normal(0, 3, (10, 2))])
    rows = [(512, 28, 6, 0, f"i{i}", float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(640, 28, 6, 0, f"s{i}", float(i), 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "resolution int, font_size int, line_spacing int, letter_spacing int, image_id string, x double, y double")
    kept = {r.image_id for r in trim_sparse(df).collect()}
    dk = np.array([np.sort(np.hypot(*(pts - p).T))[10] for p in pts])
    want = {f"i{i}" for i in np.flatnonzero(dk <= np.quantile(dk, 0.95))} | {f"s{i}" for i in range(9)}
    assert kept == want


def test_interval_filter_keeps_rows_without_a_distance(spark):
    from pagescale.operators.windows import filter_by_interval

    nan = float("nan")
    rows = [("a", t, d) for t, d in [(10, 0.1), (110, 0.2), (110, nan), (110, None), (110, 0.9), (None, 0.5), (310, nan), (310, 0.1)]]
    rows += [("b", 10, 0.5), ("b", 10, nan), ("b", 310, None)]
    points = spark.createDataFrame(rows, "g string, text_len int, edit_distance double").selectExpr("*", "1280 as resolution")
    bounds = spark.createDataFrame([("a", 1280, 100.0, 200.0), ("b", 1280, None, 200.0)], "g string, resolution int, L double, R double")
    got = [(r.g, r.text_len, str(r.edit_distance)) for r in filter_by_interval(points, bounds, ["g", "resolution"], 100).collect()]
    assert sum(g == "b" for g, *_ in got) == 3
    assert not any(g == "a" and t == 310 for g, t, _ in got) and ("a", None, "0.5") in got
    assert {d for g, t, d in got if (g, t) == ("a", 110)} >= {"0.2", "nan", "None"} and ("a", 110, "0.9") not in got


def test_interval_ignores_values_that_are_not_finite(spark):
    from pagescale.operators.windows import variance_interval

    rows = [(t * 10, (t % 7) * 0.1) for t in range(1, 60)]
    odd = [(55, float("nan")), (155, float("inf")), (255, None)]
    ask = lambda x: variance_interval(spark.createDataFrame(x, "text_len int, edit_distance double").selectExpr("*", "'a' as g"), ["g"], 100).collect()
    assert ask(rows) == ask(rows + odd)


def test_sorted_and_counted_groups_have_the_same_quantiles(spark):
    """groups that fit a sort no longer go through passes of buckets; both ways give the same values."""
    rng = np.random.default_rng(9)
    rows = [(g, float(v)) for g, n in (("a", 300), ("b", 40), ("c", 1), (None, 70)) for v in np.round(rng.normal(0, 1, n), 2)]
    rows += [("d", float("nan")), ("d", 1.0), ("d", float("inf")), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p3": 0.3, "p9": 0.9, "p10": 1.0}
    ask = lambda few: sorted(map(str, exact_quantiles(df, ["g"], "v", probs, few=few).collect()))
    assert ask(0) == ask(50) == ask(10**6) and len(ask(50)) == 5
