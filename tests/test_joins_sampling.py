"""Joins, layout merging, sampling and geometry on hand-made rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagescale import schema as S
from pagescale.functions import geometry as G
from pagescale.operators import aggregates as A
from pagescale.operators import filters as K
from pagescale.operators import joins as J
from pagescale.operators import sampling as P
from pagescale.operators import segmentation as Seg

REL = "array<struct<relation_type:string,source_anno_id:int,target_anno_id:int>>"


def layout(spark, blocks, pairs):
    rows = [(i, c, o, ig, p, t) for i, c, o, ig, p, t in blocks]
    rel = [("truncated", a, b) for a, b in pairs]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("page_id", T.IntegerType()), T.StructField("layout_dets", T.ArrayType(S.LAYOUT_BLOCK))])
    df = spark.createDataFrame([(1, rows)], schema)
    rels = F.array(*[F.struct(F.lit(t).alias("relation_type"), F.lit(a).alias("source_anno_id"), F.lit(b).alias("target_anno_id")) for t, a, b in rel]) if rel else F.lit(None)
    return df.withColumn("relations", rels.cast(REL))


def box(x0, y0, x1, y1):
    return [float(v) for v in (x0, y0, x1, y0, x1, y1, x0, y1)]


BLOCKS = [
    (10, "text_block", 3, False, box(0, 0, 5, 5), "a"), (11, "text_block", 1, False, box(4, 4, 9, 8), "b"), (12, "title", None, False, None, "c"),
    (13, "text_block", 2, True, box(1, 1, 2, 2), "d"), (14, "figure", 0, False, box(1, 1, 2, 2), None),
]


def merged(spark, pairs, **kw):
    return [(b.anno_id, b.order, b.poly, b.text) for b in J.merge_truncated(layout(spark, BLOCKS, pairs), **kw).first().layout_dets]


def test_merge_truncated(spark):
    plain = [(b[0], b[2], b[4], b[5]) for b in BLOCKS]
    assert merged(spark, []) == plain
    assert merged(spark, [(10, 99), (10, 10)]) == plain  # missing end, self link
    one = merged(spark, [(11, 10), (10, 11)])  # reversed duplicate
    assert one == [(11, 1, box(0, 0, 9, 8), "b\na"), *plain[2:]]
    chain = merged(spark, [(10, 11), (11, 12)])  # 11 is gone when its second link comes
    assert chain == one
    star = merged(spark, [(10, 11), (10, 13)])
    assert star[0] == (11, 1, box(0, 0, 9, 8), "b\nd\na") and len(star) == 3
    quirk = merged(spark, [(10, 11), (10, 13)], last_pair_only=True)
    assert quirk[0][3] == "d\na" and len(quirk) == 3


def test_layout_filters(spark):
    df = layout(spark, BLOCKS, [])
    kept = df.select(K.keep_blocks(F.col("layout_dets")).alias("b")).first().b
    assert [b.anno_id for b in kept] == [11, 10, 12]
    assert K.without_categories(df).count() == 0
    assert K.without_categories(df, ["table"]).count() == 1


def test_eval_join_variants(spark):
    images = spark.createDataFrame([("d/a.png",), ("d/a_0_16.png",), ("d/b.png",), ("d/c.png",)], "image string")
    gt = spark.createDataFrame([("x/a.jpg", "GT a", 1, 4), ("x/b.jpg", "GT b", 1, 4)], "image string, gt string, text_token_len int, text_len int")
    preds = spark.createDataFrame([("a", "# pa"), ("a_0_16", "pas")], "id string, markdown string")
    assert [(r.id, r.answer) for r in J.build_eval(images, gt, preds).collect()] == [("a", "pa")]
    got = {(r.id, r.label, r.answer) for r in J.build_eval_shifted(images, gt, preds).collect()}
    assert got == {("a", "GT a", "pa"), ("a_0_16", "GT a", "pas")}
    assert {(r.id, r.missing) for r in J.missing_report(images, gt, preds).collect()} == {("a_0_16", "ground_truth"), ("c", "ground_truth"), ("b", "prediction")}


def test_enrich_counts_and_selected(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "id string, text_len int")
    source = spark.createDataFrame([("p/a.png", 5, 0), ("q/a.png", 7, 1)], "image string, text_len int, pos int")
    rows = J.enrich_text_len(target, source)
    assert {(r.id, r.text_len) for r in rows.collect()} == {("a", 7), ("b", 2)}
    assert tuple(J.enrich_counts(rows).first()) == (1, 1)
    gt = spark.createDataFrame([("a.png", "first", 0), ("a.jpg", "second", 1)], "image string, gt string, pos int")
    found, none = J.selected_with_gt(spark.createDataFrame([("a",), ("a",), ("z",)], "id string"), gt)
    assert [(r.id, r.gt) for r in found.collect()] == [("a", "first")] and [r.id for r in none.collect()] == ["z"]


def test_canvas_fit_is_complete(spark):
    images = spark.createDataFrame([(f"i{i}", 1 + i * 37 % 900, 1 + i * 91 % 700) for i in range(60)], "id string, width int, height int")
    canvases = spark.createDataFrame([(w, h) for w in (1, 64, 127, 128, 500, 512, 1000) for h in (50, 400, 800)] + [(0, 5), (500, 400)], "canvas_w int, canvas_h int")
    got = {(r.id, r.canvas_w, r.canvas_h) for r in J.canvas_fit(images, canvases).collect()}
    im, cv = images.collect(), {(c.canvas_w, c.canvas_h) for c in canvases.collect() if c.canvas_w > 0}
    assert got == {(i.id, w, h) for i in im for w, h in cv if w >= i.width and h >= i.height}


def test_errors(spark):
    df = spark.createDataFrame([("a", 1, 0.1)], "id string, text_len int, edit_dist double")
    with pytest.raises(ValueError):
        K.select_high_error(df, 0.1, 5, 1)
    with pytest.raises(ValueError):
        P.shift_grid(df, 0)
    with pytest.raises(ValueError):
        A.box_stats(df.withColumn("resolution", F.lit(1024)))
    with pytest.raises(ValueError):
        G.capacity(F.lit(1), F.lit(1), F.lit(1.0), F.lit(1.0), 0)
    with pytest.raises(ValueError):
        J.construct_features(df, df, df, df, (21, 0, 0), 512)


def test_sampling(spark):
    df = spark.range(200).withColumnRenamed("id", "key")
    ids = lambda d: sorted(r.key for r in d.collect())
    a = ids(P.sample_n(df, 30, 1, ["key"]))
    assert len(a) == 30 and a == ids(P.sample_n(df.repartition(9), 30, 1, ["key"])) and a != ids(P.sample_n(df, 30, 2, ["key"]))
    assert P.sample_n(df, 0, 1, ["key"]).count() == 0 and P.sample_n(df, 500, 1, ["key"]).count() == 200
    groups = P.sample_groups(df, ["key"], {2: 50, 4: 20}, 7).collect()
    sets = {}
    for r in groups:
        sets.setdefault((r.k, r.group_no), []).append(r.key)
    assert sum(k == 2 for k, _ in sets) == 50 and sum(k == 4 for k, _ in sets) == 20
    assert all(len(set(v)) == k for (k, _), v in sets.items()) and len({frozenset(v) for v in sets.values()}) == 70
    few = P.sample_groups(df.limit(3), ["key"], {2: 99}, 7)  # capped at the three pairs
    assert few.select("group_no").distinct().count() == 3
    with pytest.raises(ValueError):
        P.sample_groups(df.limit(2), ["key"], {3: 1}, 7)
    split = {r.split: r["count"] for r in P.train_test_split(df, 0.25, 3, ["key"], F.col("key") < 20).groupBy("split").count().collect()}
    assert split == {"excluded": 20, "train": 135, "test": 45}


def test_pick_and_groups(spark):
    df = spark.createDataFrame([("p1", ["a", "b", "c"]), ("p2", ["x", " "]), ("p3", ["q"])], "page_id string, blocks array<string>")
    got = P.pick_per_record(df, [1, 2, 3], 5).collect()
    sizes = {(r.page_id, r.size) for r in got}
    assert {("p1", 1), ("p1", 2), ("p1", 3), ("p3", 1)} <= sizes and ("p2", 2) not in sizes and ("p3", 2) not in sizes
    assert all(len(set(r.block_nos)) == r.size and r.gt.count("\n\n") == r.size - 1 for r in got)
    long = spark.createDataFrame([(f"p{i}", b, f"t{i}{b}") for i in range(6) for b in (1, 2)], "page_id string, block_no int, text string")
    out = P.build_groups(long, {1: 5, 3: 8}, 2).collect()
    assert len(out) == 13
    for r in out:
        assert len(r.blocks) == r.k and r.gt == " ".join(f"t{c[2:].replace('B', '')}" for c in r.blocks)


def test_wide_and_back(spark):
    df = spark.createDataFrame([("b", "p1", ["x", "", "z"])], "book_name string, page_id string, blocks array<string>")
    wide = Seg.to_wide_blocks(df, 4)
    assert wide.columns == ["book_name", "page_id", "block1", "block2", "block3", "block4"]
    assert {(r.block_key, r.block_no, r.text) for r in Seg.unpivot_blocks(wide, ["book_name", "page_id"]).collect()} == {("p1_block1", 1, "x"), ("p1_block3", 3, "z")}


def test_tile_grid_against_loop(spark):
    shapes = G._tile_shapes(2, 6)

    def loop(w, h):
        gap, best = math.inf, (1, 1)
        for i, j in shapes:
            d = abs(w / h - i / j)
            if d < gap:
                gap, best = d, (i, j)
            elif d == gap and w * h > 0.5 * 640 * 640 * i * j:
                best = (i, j)
        return best

    sizes = [(w, h) for w in (100, 640, 641, 900, 2000, 5000) for h in (100, 333, 640, 1280, 4000)]
    df = spark.createDataFrame(sizes, "w int, h int")
    for r in df.select("w", "h", G.tile_grid(F.col("w"), F.col("h")).alias("t"), G.image_tokens(F.col("w"), F.col("h")).alias("n")).collect():
        c, rr = loop(r.w, r.h)
        assert (r.t.cols, r.t.rows) == (c, rr)
        local = 0 if r.w <= 640 and r.h <= 640 else rr * 10 * (c * 10 + 1)
        assert r.n == 273 + local


def test_near_square_layout_attempts(spark):
    df = spark.createDataFrame([("word " * 300,), ("x" * 3000,), ("",), ("a",)], "t string")
    for r in df.select(G.near_square_layout(F.col("t"), F.lit(28), F.lit(6), F.lit(0)).alias("l")).collect():
        assert 20 <= r.l.wrap <= 400 and r.l.n_lines >= 1 and r.l.ratio == pytest.approx(r.l.width / r.l.height)
    assert 0.9 <= df.limit(1).select(G.near_square_layout(F.col("t"), F.lit(28), F.lit(6), F.lit(0)).alias("l")).first().l.ratio <= 1.1


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.25), ("b", 0.5), ("b", None)], "g string, x double")
    got = {(r.g, r.bin): r.n for r in A.histogram_shared_edges(df, "g", "x", 4).collect()}
    assert got == {("a", 0): 1, ("a", 1): 0, ("a", 2): 0, ("a", 3): 1, ("b", 0): 0, ("b", 1): 1, ("b", 2): 1, ("b", 3): 0}
    flat = A.histogram_shared_edges(spark.createDataFrame([("a", 3.0)] * 5, "g string, x double"), "g", "x", 2).collect()
    assert sum(r.n for r in flat) == 5 and min(r.left_edge for r in flat) == 2.5


def test_nearest_by_key_against_loop(spark):
    hist = [(10, 1), (10, 3), (2000, 2), (2100, 9), (5000, 4)]
    want = [1, 10, 900, 1005, 1006, 2050, 3000, 9000]
    h = spark.createDataFrame(hist, "token_len int, wrap_width int")
    got = {r.token_len: (r.nearest_len, r.wrap_width) for r in A.nearest_by_key(h, spark.createDataFrame([(w,) for w in want], "token_len int")).collect()}
    for w in want:
        n = min((abs(t - w), t) for t, _ in hist)[1]
        assert got[w] == (n, min(x for t, x in hist if t == n))


def test_canvases_of_any_width(spark):
    images = spark.createDataFrame([("a", 100, 100), ("wide", 5_000_000, 10)], "id string, width int, height int")
    canvases = spark.createDataFrame([(200, 200), (3_000_000, 200)], "canvas_w int, canvas_h int")
    assert {(r.id, r.canvas_w) for r in J.canvas_fit(images, canvases).collect()} == {("a", 200), ("a", 3_000_000)}


def test_last_record_of_an_id_counts(spark):
    images = spark.createDataFrame([("x/p1.png", 100, 200)], "image string, width int, height int")
    gt = spark.createDataFrame([("p1.png", "new", 2, 20, 1), ("p1.png", "old", 1, 10, 0)], "image string, gt string, text_token_len int, text_len int, pos int")
    preds = spark.createDataFrame([("p1", "seen", 0), ("p1", "seen last", 1)], "id string, markdown string, pos int")
    for build in (J.build_eval, J.build_eval_shifted):
        assert [(r.label, r.answer, r.text_len) for r in build(images, gt, preds).collect()] == [("new", "seen last", 20)]
    metrics = spark.createDataFrame([("p1", 0.5, 1), ("p1", 0.9, 0)], "id string, edit_dist double, pos int")
    got = J.density_with_metrics(images, gt, metrics, 14.0, 32.0, 1024).collect()
    assert [(r.text_len, r.edit_dist) for r in got] == [(10, 0.5)]
    sizes = spark.createDataFrame([("p1", 1024, 10, 0), ("p1", 2048, 10, 1)], "id string, width int, height int, pos int")
    points = metrics.where("pos = 1").selectExpr("id", "3 as text_len", "edit_dist")
    assert [r.scale for r in J.points_with_sizes(points, sizes).collect()] == [2.0]


def test_density_records_own_values_come_first(spark):
    images = spark.createDataFrame([("p1.png", 100, 200), ("p2.png", 100, 200)], "image string, width int, height int")
    density = spark.createDataFrame([("p1", 0.5, 7, 70, 0.25), ("p2", 0.5, None, None, None)], "id string, patch_density double, token_len int, text_len int, edit_distance double")
    meta = spark.createDataFrame([("p2.png", 3, 30)], "image string, text_token_len int, text_len int")
    metrics = spark.createDataFrame([("p1", 0.9), ("p2", 0.75)], "id string, edit_dist double")
    got = J.construct_features(density, meta, images, metrics, (28, 6, 0), 1024).collect()
    assert {(r.image_id, r.token_len, r.text_len, r.edit_distance) for r in got} == {("p1", 7, 70, 0.25), ("p2", 3, 30, 0.75)}


def test_draws_are_subsets_and_never_lost(spark):
    got = P.draw_groups(spark, 10, {10: 1, 9: 3, 2: 20}, 42).collect()
    assert [r.m for r in got if r.k == 10] == [list(range(10))]
    assert len([r for r in got if r.k == 9]) == 3 and len({tuple(r.m) for r in got if r.k == 2}) == 20
    assert all(len(set(r.m)) == r.k and r.m == sorted(r.m) and 0 <= r.m[0] and r.m[-1] < 10 for r in got)


def test_subsets_are_numbered_without_gaps(spark):
    for n, k in ((7, 3), (6, 6), (5, 1), (9, 2), (4, 0)):
        got = P.draw_groups(spark, n, {k: 10_000}, 1).collect()
        assert sorted(tuple(r.m) for r in got) == sorted(itertools.combinations(range(n), k))
    # too many subsets for 64-bit numbers: members come from residue classes
    assert len(P.classes(40_000, 10)) > 1
    got = [tuple(r.m) for r in P.draw_groups(spark, 40_000, {10: 500}, 3).collect()]
    assert len(set(got)) == 500 and all(len(set(m)) == 10 and list(m) == sorted(m) and 0 <= m[0] and m[-1] < 40_000 for m in got)
    counts = np.bincount(np.array(got).ravel() * 8 // 40_000, minlength=8)
    assert counts.min() > 500 and counts.max() < 750  # spread evenly over the positions


def test_permutation_of_numbers(spark):
    for size in (1, 2, 9, 10, 97, 1000, 4099):
        got = [r.x for r in spark.range(size).select(P.permuted(F.col("id"), size, 5).alias("x")).collect()]
        assert sorted(got) == list(range(size))


def test_samples_of_one_seed_are_nested(spark):
    df = spark.range(1000).select(F.col("id").alias("key"))
    ids = lambda n: {r.key for r in P.sample_n(df, n, 42, ["key"]).collect()}
    assert ids(10) < ids(400) < ids(999) and len(ids(400)) == 400


def test_split_moves_no_rows_but_those_at_the_cut(spark):
    """all rows were sorted by their hash."""
    from pagescale.operators.quantiles import hash_rank
    from pagescale.operators.sampling import train_test_split

    df = spark.range(997).selectExpr("id", "id % 7 AS g", "IF(id % 10 = 0, NULL, id) AS k")
    for frac in (0.0, 0.2, 0.5, 0.999):
        got = train_test_split(df, frac, 42, ["id", "k"])
        rank = {r.id: r.rank for r in hash_rank(df, ["id", "k"], 42).collect()}
        assert {r.id for r in got.where("split = 'train'").collect()} == {i for i, n in rank.items() if n < int(997 * (1 - frac))}
        assert got.count() == 997 and got.columns == ["id", "g", "k", "split"]
    assert train_test_split(df.limit(0), 0.2, 42, ["id"]).count() == 0


def test_split_reads_rows_once_after_the_cut_is_known(spark):
    """rows were hashed and read a second time, with a window, for those at the cut; rows of one hash still keep the exact share."""
    from pagescale.operators.sampling import train_test_split

    df = spark.range(1001).selectExpr("id")
    plan = train_test_split(df, 0.3, 7, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Window" not in plan
    for copies in (2, 5):
        twice = spark.range(300).selectExpr(f"id div {copies} AS id", "id AS row")
        for frac in (0.1, 0.35, 0.77):
            got = train_test_split(twice, frac, 7, ["id"])
            assert got.count() == 300 and got.where("split = 'train'").count() == int(300 * (1 - frac))
    assert train_test_split(spark.range(1).selectExpr("id", "0 AS k"), 0.0, 7, ["k"]).where("split = 'train'").count() == 1
