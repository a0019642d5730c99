"""Queries on seeded sampling and data-set construction. Sample sizes follow the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale.functions import text as X
from pagescale.operators import filters as K
from pagescale.operators import sampling as O
from pagescale.operators.filters import keep_blocks
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query, r6
from pagescale.plans.draws import draws
from pagescale.plans.segments import SEGMENT, WORDS, chunk_sql


def _blocks(spark, d):
    """Blocks of all documents: four per document, blanks out."""
    df = fx.documents(spark, d).select(F.col("doc_id").cast("string").alias("page_id"), X.chunk_by_chars(X.split_sentences(X.normalize_ws(F.col("text"))), 4).alias("blocks"))
    long = df.select("page_id", F.posexplode("blocks").alias("b", "text")).where(F.col("text") != "")
    return long.select("page_id", (F.col("b") + 1).alias("block_no"), "text")


@query("smp1_sample_n", """SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (ORDER BY md5('42/'||doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
    WHERE rn <= greatest(1, n//10)""")
def sample_n(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return O.sample_n(docs, max(1, docs.count() // 10), 42, ["doc_id"])


@query(
    "smp2_sample_groups",
    f"""WITH {draws("count(*) FROM documents", {3: ("(SELECT count(*)//5 FROM documents)", 1)}, 42)},
    pos AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42/'||doc_id), doc_id)-1 AS pos FROM documents),
    flat AS (SELECT k, group_no, unnest(m) AS pos, generate_subscripts(m, 1)-1 AS member_no FROM drawn)
    SELECT k, group_no, CAST(member_no AS INT) AS member_no, doc_id FROM flat JOIN pos USING (pos)""",
)
def sample_groups(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    return O.sample_groups(docs, ["doc_id"], {3: docs.count() // 5}, 42)


GROUPS = {k: (f"(SELECT count(*)//{share} FROM documents)", s) for k, share, s in ((1, 10, 1), (2, 10, 1), (3, 20, 1), (5, 20, 1), (10, 20, 2))}


@query(
    "smp4_build_groups",
    f"""WITH RECURSIVE cut AS ({chunk_sql("length(t)", "=", 4)}),
    blk AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, block+1 AS block_no, text FROM cut WHERE text <> ''),
    {draws("count(*) FROM blk", GROUPS, 42)},
    pos AS (SELECT *, row_number() OVER (ORDER BY md5('42/'||page_id||'/'||block_no), page_id, block_no)-1 AS pos FROM blk),
    flat AS (SELECT k, group_no, unnest(m) AS pos, generate_subscripts(m, 1) AS member_no FROM drawn),
    item AS (SELECT k, group_no, member_no, 'C'||page_id||'B'||block_no AS code, text FROM flat JOIN pos USING (pos))
    SELECT k, group_no, 'group_'||k||'_'||string_agg(code, '' ORDER BY member_no) AS image, string_agg(code, ',' ORDER BY member_no) AS blocks, string_agg(text, ' ' ORDER BY member_no) AS gt
    FROM item GROUP BY k, group_no""",
)
def build_groups(spark, d):
    blocks = _blocks(spark, d)
    n = fx.table(spark, d, "documents").count()
    plan = {1: n // 10, 2: n // 10, 3: n // 20, 5: n // 20, 10: n // 20}
    out = O.build_groups(blocks, plan, 42)
    return out.select("k", "group_no", "image", F.array_join("blocks", ",").alias("blocks"), "gt")


@query(
    "smp5_pick_per_record",
    f"""WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, i, text FROM ({' UNION ALL '.join(f'SELECT doc_id, {i} AS i, {SEGMENT(i, 4)} AS text FROM ({WORDS})' for i in range(4))})),
    r AS (SELECT page_id, size, i, text, row_number() OVER (PARTITION BY page_id, size ORDER BY md5(concat_ws('/', 42, page_id, size, i)), i) AS rn FROM b, (VALUES (1), (2), (3)) s(size))
    SELECT page_id, size, string_agg(CAST(i+1 AS VARCHAR), ',' ORDER BY rn) AS block_nos, string_agg(text, chr(10)||chr(10) ORDER BY rn) AS gt
    FROM r WHERE rn <= size GROUP BY page_id, size HAVING min(length(text)) > 0""",
)
def pick(spark, d):
    df = fx.documents(spark, d).select(F.col("doc_id").cast("string").alias("page_id"), X.equal_word_segments(F.col("text"), 4).alias("blocks"))
    return O.pick_per_record(df, [1, 2, 3], 42).withColumn("block_nos", F.array_join(F.transform("block_nos", lambda i: i.cast("string")), ","))


@query(
    "smp6_cross_widths",
    "SELECT id, width, CAST(greatest(greatest(width-40, 50)//8, 10) AS INT) AS wrap_width FROM (SELECT id FROM images) i, (VALUES (60),(400),(800),(1600)) w(width)",
)
def widths(spark, d):
    return O.cross_widths(fx.images(spark, d).select("id"), [800, 400, -5, 0, 60, 400, 1600])


@query(
    "smp7_cross_styles",
    "SELECT id, font_size, line_spacing, letter_spacing FROM (SELECT id FROM images) i, (VALUES (20),(28),(36)) f(font_size), (VALUES (0),(6),(24),(42)) l(line_spacing), (VALUES (-1),(0),(7)) c(letter_spacing)",
)
def styles(spark, d):
    return O.cross_styles(fx.images(spark, d).select("id"))


@query(
    "smp8_cross_density_groups",
    "SELECT id, density_group, font_size, line_spacing, letter_spacing FROM (SELECT id FROM images) i, (VALUES ('GroupA',28,6,0),('GroupB',28,2,-1),('GroupC',28,12,6)) g(density_group, font_size, line_spacing, letter_spacing)",
)
def presets(spark, d):
    return O.cross_density_groups(fx.images(spark, d).select("id"))


@query(
    "smp9_shift_grid",
    "SELECT id||'_'||x||'_'||y AS shift_id, id AS base_id, x, y, 1008 AS inner_size FROM (SELECT id FROM images) i, (VALUES (0),(5),(10),(15),(16)) a(x), (VALUES (0),(5),(10),(15),(16)) b(y)",
)
def shifts(spark, d):
    return O.shift_grid(fx.images(spark, d).select("id"), 5)


@query("smp10_pending_only", "SELECT id FROM images WHERE id NOT IN (SELECT id FROM predictions)")
def pending(spark, d):
    return K.pending_only(fx.images(spark, d).select("id"), fx.predictions(spark, d).select("id"))


@query(
    "smp11_artifact_diff",
    """WITH u AS (SELECT DISTINCT o_custkey AS k FROM orders), e AS (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey+3 FROM orders WHERE o_orderstatus='F')
    SELECT (SELECT count(*) FROM u WHERE k NOT IN (SELECT k FROM e)) AS n_new, (SELECT count(*) FROM u WHERE k IN (SELECT k FROM e)) AS n_reused, (SELECT count(*) FROM e WHERE k NOT IN (SELECT k FROM u)) AS n_stale""",
)
def artifacts(spark, d):
    orders = fx.table(spark, d, "orders")
    existing = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("name")).unionByName(orders.where(F.col("o_orderstatus") == "F").select((F.col("o_custkey") + 3).alias("name")))
    return K.artifact_diff(orders.select(F.col("o_custkey").alias("name")), existing)




@query(
    "smp12_train_test_split",
    """WITH t AS (SELECT count(*) AS n FROM analysis_points WHERE NOT (font_size=28 AND line_spacing=6 AND letter_spacing=0)), x AS (SELECT count(*) AS n FROM analysis_points WHERE font_size=28 AND line_spacing=6 AND letter_spacing=0)
    SELECT 'train' AS split, CAST(floor(n*0.8::DOUBLE) AS BIGINT) AS n FROM t UNION ALL SELECT 'test', CAST(n-floor(n*0.8::DOUBLE) AS BIGINT) FROM t UNION ALL SELECT 'excluded', n FROM x""",
)
def split(spark, d):
    pts = fx.analysis_points(spark, d)
    base = (F.col("font_size") == 28) & (F.col("line_spacing") == 6) & (F.col("letter_spacing") == 0)
    out = O.train_test_split(pts, 0.2, 42, ["image_id", "resolution", "font_size", "line_spacing", "letter_spacing"], base)
    return out.groupBy("split").agg(F.count("*").alias("n"))


@query(
    "smp13_sample_frac_by",
    """SELECT resolution, count(*) AS n, round(avg(edit_distance)+1e-9, 6) AS mean_ed FROM analysis_points
    WHERE ('0x'||substr(md5(concat_ws('/', 42, image_id, resolution, font_size, line_spacing, letter_spacing)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
      < CASE resolution WHEN 512 THEN 0.5::DOUBLE WHEN 640 THEN 0.25::DOUBLE WHEN 1024 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END GROUP BY resolution""",
)
def sample_by(spark, d):
    pts = fx.analysis_points(spark, d)
    ids = ["image_id", "resolution", "font_size", "line_spacing", "letter_spacing"]
    got = O.sample_frac_by(pts, "resolution", {512: 0.5, 640: 0.25, 1024: 1.0}, 42, ids)
    return got.groupBy("resolution").agg(F.count("*").alias("n"), r6(F.avg("edit_distance")).alias("mean_ed"))


@query(
    "smp14_cap_per_group",
    "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn <= 50",
)
def cap(spark, d):
    from pagescale.operators.aggregates import cap_per_group

    rows = fx.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return cap_per_group(rows, ["l_returnflag"], 50, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query(
    "smp15_cumulative_pages",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(ord, 2147483647), i) AS no FROM layout_blocks WHERE lower(category_type) IN ('title','text_block') AND NOT ign),
    c AS (SELECT page_id, no, anno_id, min(x0) OVER w AS x0, min(y0) OVER w AS y0, max(x1) OVER w AS x1, max(y1) OVER w AS y1, count(*) OVER w AS n_blocks, sum(x0) OVER w AS sx FROM k WHERE x0 IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY no)),
    b AS (SELECT page_id, no, n_blocks, sx, greatest(0, CAST(floor(least(1600, x0)) AS INT)) AS x0, greatest(0, CAST(floor(least(2200, y0)) AS INT)) AS y0, least(1600, CAST(ceil(greatest(0, x1)) AS INT)) AS x1, least(2200, CAST(ceil(greatest(0, y1)) AS INT)) AS y1 FROM c)
    SELECT page_id, CAST(no AS INT) AS prefix_no, x0, y0, x1, y1, x1-x0 AS width, y1-y0 AS height, CAST(n_blocks AS INT) AS n_blocks, round(sx - n_blocks*x0, 6) AS moved_x FROM b WHERE x1 > x0 AND y1 > y0""",
)
def cumulative(spark, d):
    pages = fx.layout_pages(spark, d).select("page_id", "width", "height", keep_blocks(F.col("layout_dets")).alias("layout_dets"))
    out = O.cumulative_pages(pages)
    moved = F.aggregate("layout_dets", F.lit(0.0), lambda a, b: a + b["poly"][0])
    return out.select("page_id", "prefix_no", "x0", "y0", "x1", "y1", "width", "height", F.size("layout_dets").alias("n_blocks"), F.round(moved, 6).alias("moved_x"))
