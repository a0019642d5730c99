"""Queries on filters, predicates, record upkeep, sources and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale import constants as C
from pagescale import schema as S
from pagescale.functions import text as X
from pagescale.operators import filters as O
from pagescale.plans import fixtures as fx
from pagescale.plans import segments as _segments  # noqa: F401  its SQL is used below
from pagescale.plans.catalog import ORACLES, query, r6
from pagescale.session import scratch_path, table
from pagescale.sources import files, sinks


@query("flt1_select_high_error", "SELECT DISTINCT id FROM metric_records WHERE text_len BETWEEN 4000 AND 20000 AND edit_dist >= 0.5")
def high_error(spark, d):
    return O.select_high_error(fx.metric_records(spark, d), 0.5, 4000, 20000)


@query(
    "flt2_split_by_max_len",
    """SELECT i.id, CASE WHEN coalesce(g.text_len, 0) <= 2000 THEN 'kept' ELSE 'removed' END AS part
    FROM images i LEFT JOIN ground_truth g USING (id)""",
)
def split_max_len(spark, d):
    gt = fx.ground_truth(spark, d).select(X.file_stem(F.col("image")).alias("id"), "text_len")
    rows = fx.images(spark, d).select("id").join(gt, "id", "left")
    kept, removed = O.split_by_max_len(rows, 2000, "text_len")
    return kept.select("id", F.lit("kept").alias("part")).unionByName(removed.select("id", F.lit("removed").alias("part")))


@query(
    "flt3_stable_vs_long",
    """SELECT id, text_len, edit_dist, 'stable' AS label FROM metric_records WHERE text_len <= 15000 AND edit_dist <= 0.1
    UNION ALL SELECT id, text_len, edit_dist, 'long' FROM metric_records WHERE text_len >= 10000""",
)
def stable_long(spark, d):
    return O.stable_vs_long(fx.metric_records(spark, d), 15000, 0.1, 10000)


@query(
    "flt4_without_categories",
    "SELECT doc_id AS page_id FROM documents WHERE doc_id NOT IN (SELECT page_id FROM layout_blocks WHERE category_type LIKE '%figure%')",
)
def no_figures(spark, d):
    return O.without_categories(fx.layout_pages(spark, d)).select("page_id")


KEPT = "SELECT * FROM layout_blocks WHERE lower(category_type) IN ('title','text_block') AND NOT ign"


@query(
    "flt5_keep_blocks",
    f"""SELECT page_id, string_agg(CAST(anno_id AS VARCHAR), ',' ORDER BY coalesce(ord, 2147483647), i) AS blocks, count(*) AS n
    FROM ({KEPT}) GROUP BY page_id""",
)
def kept_blocks(spark, d):
    pages = fx.layout_pages(spark, d).select("page_id", O.keep_blocks(F.col("layout_dets")).alias("b")).where(F.size("b") > 0)
    return pages.select("page_id", F.array_join(F.transform("b", lambda b: b["anno_id"].cast("string")), ",").alias("blocks"), F.size("b").cast("long").alias("n"))


@query("flt6_cjk_flag", "SELECT doc_id, lang = 'es' AS cjk FROM documents")
def cjk(spark, d):
    marked = F.concat("text", F.when(F.col("lang") == "es", "頁").when(F.col("lang") == "de", "あ").otherwise(""))
    return table(spark, d, "documents").select("doc_id", X.has_cjk(marked).alias("cjk"))


@query(
    "flt7_finite_positive",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_tax/l_discount)+1e-9, 6) AS total FROM lineitem WHERE l_discount > 0 GROUP BY ALL""",
)
def finite(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_discount", F.try_divide("l_tax", "l_discount").alias("ratio"))
    return O.finite_positive(li, "l_discount", "ratio").groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.sum("ratio")).alias("total"))


@query(
    "flt8_prefix_filter",
    "SELECT image_path FROM layout_names WHERE image_path LIKE 'newspaper%' AND page_id IN (SELECT doc_id FROM labels)",
)
def prefix(spark, d):
    names = fx.layout_pages(spark, d).select("image_path", "page_id")
    records = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"))
    with_record = names.join(records, "page_id", "left_semi").select("image_path")
    return O.prefix_filter(names.select("image_path"), with_record, "newspaper", "image_path")


@query(
    "flt9_style_filter",
    """SELECT resolution, font_size=28 AND line_spacing=6 AND letter_spacing=0 AS baseline, count(*) AS n, round(avg(edit_distance)+1e-9, 6) AS mean_ed
    FROM analysis_points GROUP BY ALL""",
)
def style(spark, d):
    pts = fx.analysis_points(spark, d)
    agg = lambda p, b: p.groupBy("resolution").agg(F.count("*").alias("n"), r6(F.avg("edit_distance")).alias("mean_ed")).withColumn("baseline", F.lit(b))
    return agg(O.style_filter(pts), True).unionByName(agg(O.style_filter(pts, exclude=True), False))


@query(
    "flt10_resolution_policy",
    """SELECT resolution, count(*) AS n, max(edit_distance) AS worst FROM analysis_points
    WHERE edit_distance <= CASE WHEN resolution IN (512, 640) THEN 0.4 ELSE 0.2 END GROUP BY ALL""",
)
def policy(spark, d):
    return O.resolution_policy_filter(fx.analysis_points(spark, d)).groupBy("resolution").agg(F.count("*").alias("n"), F.max("edit_distance").alias("worst"))


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("src1_read_corpus", "SELECT CAST(sum(length(text)+1) AS BIGINT) AS n_chars, CAST(sum(length(text)-length(replace(text, chr(10), ''))+1) AS BIGINT) AS n_lines FROM documents")
def corpus(spark, d):
    path = scratch_path(spark, "corpus")
    with_bom = F.concat(F.lit("﻿"), "text")
    fx.documents(spark, d).select(with_bom).write.option("maxRecordsPerFile", 50).text(path)
    got = files.read_corpus(spark, path)
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return got.agg(F.sum(F.length("text")).alias("n_chars"), F.sum(breaks).alias("n_lines"))


def _json_arrays(df, key, per_file, junk=""):
    """Records packed into JSON arrays of at most ``per_file`` items, one array per file line."""
    item = F.to_json(F.struct(*[c for c in df.columns if c != "_k"]))
    packed = df.withColumn("_k", F.floor(F.col(key) / per_file)).groupBy("_k").agg(F.collect_list(item).alias("items"))
    return packed.select(F.concat(F.lit("["), F.array_join("items", ","), F.lit(junk), F.lit("]")).alias("value"))


@query(
    "src2_read_records",
    """SELECT 'list' AS root, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS text_len FROM documents
    UNION ALL SELECT 'keyed', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents""",
)
def records(spark, d):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("answer", T.StringType())])
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), F.col("text").alias("answer"))
    listed, keyed, bad = scratch_path(spark, "list"), scratch_path(spark, "keyed"), scratch_path(spark, "bad")
    _json_arrays(docs, "doc_id", 50, ',"stray",7').write.option("maxRecordsPerFile", 1).text(listed)
    broken = table(spark, d, "documents").select(F.concat(F.lit('[{"id": "'), F.col("doc_id"), F.lit('", "answer": ')))
    broken.write.option("maxRecordsPerFile", 100).text(bad)
    pair = F.concat(F.lit('"'), F.col("id"), F.lit('":'), F.to_json(F.struct("id", "answer")))
    docs.groupBy(F.floor(F.col("doc_id") / 50).alias("_k")).agg(F.array_join(F.collect_list(pair), ",").alias("p")).select(
        F.concat(F.lit("{"), "p", F.lit("}"))
    ).write.option("maxRecordsPerFile", 1).text(keyed)
    size = lambda df, name: df.agg(F.count("*").alias("n"), F.sum(F.length("answer")).alias("text_len")).withColumn("root", F.lit(name))
    return size(files.read_records(spark, [listed, bad], schema), "list").unionByName(size(files.read_records(spark, keyed, schema), "keyed"))


@query(
    "src3_read_metric_tree",
    """SELECT lang AS dataset, resolution, count(*) AS n, round(avg(edit_dist)+1e-9, 6) AS mean_ed
    FROM metric_records m JOIN documents d ON m.id = 'doc_'||d.doc_id GROUP BY ALL""",
)
def metric_tree(spark, d):
    """One write by set and folder; a language of its own stands for rows without one, a folder that is no number is not read."""
    root = scratch_path(spark, "tree")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), F.concat(F.coalesce("lang", F.lit("none")), F.lit("_square")).alias("set"))
    rows = fx.metric_records(spark, d).join(docs, "id").withColumn("folder", F.col("resolution").cast("string")).drop("resolution")
    rows = rows.withColumn("folder", F.explode(F.when(F.col("folder") == "1280", F.array("folder", F.lit("notes"))).otherwise(F.array("folder"))))
    sinks.write_records(rows, root, "json", partition_by=["set", "folder"])
    got = files.read_metric_tree(spark, root, lines=True).withColumn("dataset", F.nullif("dataset", F.lit("none")))
    return got.groupBy("dataset", "resolution").agg(F.count("*").alias("n"), r6(F.avg("edit_dist")).alias("mean_ed"))


@query(
    "src4_read_analysis_csv",
    "SELECT resolution, count(*) AS n, count(CASE WHEN text_len >= 4000 THEN 1 END) AS n_scored, round(avg(CASE WHEN text_len >= 4000 THEN edit_distance END)+1e-9, 6) AS mean_ed FROM analysis_points GROUP BY ALL",
)
def analysis_csv(spark, d):
    path = scratch_path(spark, "csv")
    pts = fx.analysis_points(spark, d)
    full = pts.select(*[(F.col(f.name) if f.name in pts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.ANALYSIS_POINTS.fields])
    full = full.withColumn("edit_distance", F.when(F.col("text_len") >= 4000, F.col("edit_distance")))
    sinks.write_records(full, path, "csv")
    return files.read_analysis_csv(spark, path).groupBy("resolution").agg(
        F.count("*").alias("n"), F.count("edit_distance").alias("n_scored"), r6(F.avg("edit_distance")).alias("mean_ed")
    )


@query("src5_read_predictions", "SELECT count(*) AS n, CAST(sum(length(answer)) AS BIGINT) AS plain_len FROM plain_predictions")
def read_preds(spark, d):
    path = scratch_path(spark, "md")
    sinks.write_texts(fx.predictions(spark, d), F.col("markdown"), path, by="id")
    got = files.read_predictions(spark, path, glob="*.txt")
    return got.agg(F.count("*").alias("n"), F.sum(F.length(X.md_to_text(F.col("markdown")))).alias("plain_len"))


@query("src6_list_images")
def listing(spark, d):
    return files.list_images(spark, d, ("parquet",)).groupBy("id").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


@query(
    "src7_write_records",
    """SELECT f.fmt, resolution, count(*) AS n, round(sum(edit_dist)+1e-9, 5) AS total FROM metric_records, (VALUES ('csv'),('json'),('parquet')) f(fmt) GROUP BY ALL""",
)
def write_back(spark, d):
    rows = fx.metric_records(spark, d)
    out = []
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, fmt)
        sinks.write_records(rows, path, fmt, partition_by=["resolution"])
        reader = spark.read.schema(rows.schema)
        reader = reader.option("header", True).option("nullValue", "Null") if fmt == "csv" else reader
        back = reader.format(fmt).load(path)
        out.append(back.groupBy("resolution").agg(F.count("*").alias("n"), r6(F.sum("edit_dist"), 5).alias("total")).withColumn("fmt", F.lit(fmt)))
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "src9_upsert_run_records",
    """SELECT 'doc_'||coalesce(o.doc_id, n.doc_id) AS image_id, coalesce(n.fin, o.fin) AS finish_reason
    FROM (SELECT doc_id, CASE WHEN n_chars > 6000 THEN 'length' ELSE 'stop' END AS fin FROM documents WHERE lang = 'en') o
    FULL JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'fail' ELSE 'stop' END AS fin FROM labels) n ON o.doc_id = n.doc_id""",
)
def upsert(spark, d):
    name = F.concat(F.lit("doc_"), F.col("doc_id")).alias("image_id")
    docs = table(spark, d, "documents").where(F.col("lang") == "en")
    old = docs.select(name, F.when(F.col("n_chars") > 6000, "length").otherwise("stop").alias("finish_reason"))
    new = table(spark, d, "labels").select(name, F.when(F.col("toxic") == 1, "fail").otherwise("stop").alias("finish_reason"))
    return O.upsert_run_records(old, new)


@query(
    "src11_try_number",
    """SELECT page_id, coalesce(TRY_CAST(seg AS INT), -1) AS as_int, coalesce(TRY_CAST(seg AS DOUBLE), -1.0) AS as_double
    FROM (SELECT page_id, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS seg FROM pages)""",
)
def numbers(spark, d):
    seg = F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1)
    return table(spark, d, "pages").select(
        "page_id", F.coalesce(O.try_number(seg, "int"), F.lit(-1)).alias("as_int"), F.coalesce(O.try_number(seg), F.lit(-1.0)).alias("as_double")
    )


@query(
    "src12_to_analysis_rows",
    """SELECT id AS image_id, edit_dist AS edit_distance, text_token_len AS token_len, text_len, resolution, 28 AS font_size, 6 AS line_spacing, 0 AS letter_spacing
    FROM metric_records WHERE text_len >= 2000""",
)
def analysis_rows(spark, d):
    rows = fx.metric_records(spark, d).withColumn("edit_dist", F.when(F.col("text_len") >= 2000, F.col("edit_dist").cast("string")).otherwise("n/a"))
    return O.to_analysis_rows(rows, 28, 6, 0)


# --- set operations -----------------------------------------------------------------------------------------------


@query(
    "set1_concat_groups",
    """SELECT part, count(*) AS n FROM (SELECT 'low' AS part FROM metric_records WHERE resolution <= 640 UNION ALL SELECT 'high' FROM metric_records WHERE resolution > 640) GROUP BY ALL""",
)
def concat(spark, d):
    m = fx.metric_records(spark, d)
    parts = [m.where(F.col("resolution") <= 640).withColumn("part", F.lit("low")), m.where(F.col("resolution") > 640).withColumn("part", F.lit("high"))]
    return O.concat_groups(parts).groupBy("part").agg(F.count("*").alias("n"))


@query(
    "set2_distinct_first",
    "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
)
def first_of(spark, d):
    return O.distinct_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query(
    "set3_except_intersect",
    """SELECT 'except' AS op, doc_id FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)
    UNION ALL SELECT 'intersect', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""",
)
def set_ops(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return docs.exceptAll(labels).select(F.lit("except").alias("op"), "doc_id").unionByName(docs.intersect(labels).select(F.lit("intersect").alias("op"), "doc_id"))


@query(
    "udf1_registered_functions",
    r"""SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm_len, round(256.0::DOUBLE/(14.0533::DOUBLE*(512.0::DOUBLE/(n_chars+300))*26*(512.0::DOUBLE/(n_chars+400))), 6) AS density,
    'R=512|fs=28.5|ls=1.23457e+06|cs=-1' AS gid, levenshtein(md5(text), md5(lang))/32.0::DOUBLE AS dist, doc_id%7=0 AS cjk, 'doc_'||doc_id||'.x' AS stem, 'doc_'||doc_id AS base, lang||'  x' AS fenced,
    source||' l' AS plain, CASE doc_id%3 WHEN 0 THEN 14 WHEN 1 THEN 9 ELSE 1994 END AS roman, 64.0::DOUBLE AS tokens, round(n_chars*26.0::DOUBLE/32, 6) AS ink, 2 AS cols, 1 AS n_rows, CASE WHEN doc_id%2=0 THEN 483 ELSE 273 END AS image_tokens,
    3 AS n_sentences FROM documents""",
)
def sql_functions(spark, d):
    from pagescale.functions.registry import register_functions

    register_functions(spark)
    table(spark, d, "documents").createOrReplaceTempView("documents_udf1")
    df = spark.sql(
        r"""SELECT doc_id, length(normalize_ws(text)) AS norm_len, patch_density(n_chars + 300, n_chars + 400, 14.0533D, 26D, 512D) AS density, group_id(512, 28.5D, 1234567, -1) AS gid,
        ocr_edit_dist(md5(text), md5(lang)) AS dist, has_cjk(concat(lang, CASE WHEN doc_id % 7 = 0 THEN '字' ELSE '' END)) AS cjk, file_stem(concat('a/b/doc_', doc_id, '.x.png')) AS stem,
        strip_shift_suffix(concat('doc_', doc_id, '_3_5')) AS base, strip_fences(concat('\n```json\n', lang, '  x\n```\n')) AS fenced, md_to_text(concat('# ', source, '\n\u00a0- [l](u) ![i](j)')) AS plain,
        roman_to_int(CASE doc_id % 3 WHEN 0 THEN 'xiv' WHEN 1 THEN 'IX' ELSE 'MCMXCIV' END) AS roman, vision_tokens(512) AS tokens, information_density(n_chars, 28, 6, 0) AS ink,
        tile_grid(1280, 640).cols AS cols, tile_grid(1280, 640).rows AS n_rows, CASE WHEN doc_id % 2 = 0 THEN image_tokens(1280, 640) ELSE image_tokens(600, 500) END AS image_tokens,
        size(split_sentences(concat(lang, '. \u00a0 ! ', source))) AS n_sentences FROM documents_udf1"""
    )
    return df.withColumns({c: F.round(c, 6) for c in ("density", "ink")})


@query("udf2_token_counter", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INT) AS n_tokens FROM documents")
def pluggable_tokens(spark, d):
    from pagescale.functions.registry import token_counter

    return table(spark, d, "documents").select("doc_id", token_counter(lambda t: len(t.split()))(F.col("text")).alias("n_tokens"))


@query(
    "udf4_segment_table",
    f"""SELECT 'sentence' AS kind, CAST(doc_id AS VARCHAR) AS id, count(*) AS n, max(pos) AS last, sum(length(s)) AS chars FROM ({ORACLES["seg7_split_sentences"]}) GROUP BY doc_id
    UNION ALL SELECT 'block', CAST(doc_id AS VARCHAR), count(*), max(seg), sum(length(text)) FROM ({ORACLES["seg14_equal_word_segments"]}) GROUP BY doc_id
    UNION ALL SELECT 'chapter', book_name, count(*), count(*)-1, sum(length(body)) FROM ({ORACLES["seg1_numbered_chapters"]}) GROUP BY book_name""",
)
def segment_table(spark, d):
    """Segmenters as table functions in SQL, called with LATERAL."""
    from pagescale.functions.registry import register_tables

    register_tables(spark)
    table(spark, d, "documents").createOrReplaceTempView("documents_udf4")
    fx.books(spark, d, "numbered").createOrReplaceTempView("books_udf4")
    sums = "count(*) AS n, CAST(max(s.pos) AS BIGINT) AS last, sum(length({})) AS chars"
    return spark.sql(
        f"""SELECT 'sentence' AS kind, CAST(doc_id AS STRING) AS id, {sums.format('s.part')} FROM documents_udf4 d, LATERAL sentence_table(d.text) s GROUP BY doc_id
        UNION ALL SELECT 'block', CAST(doc_id AS STRING), {sums.format('s.part')} FROM documents_udf4 d, LATERAL block_table(d.text, 5) s GROUP BY doc_id
        UNION ALL SELECT 'chapter', book_name, {sums.format('s.body')} FROM books_udf4 b, LATERAL chapter_table(b.text, :marker) s GROUP BY book_name""",
        args={"marker": C.NUMBERED_MARKER},
    )
