"""Queries on cleaning of recognised output and on identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale.functions import text as X
from pagescale.operators import filters as O
from pagescale.operators import segmentation as G
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query, r6
from pagescale.plans.oracles import strip, word_list

EOS = "<｜end▁of▁sentence｜>"
TAG = r"(?s)<\|ref\|>.*?<\|/ref\|><\|det\|>.*?<\|/det\|>"


@query("cln1_md_to_text", "SELECT id, answer AS text FROM plain_predictions")
def markdown(spark, d):
    return fx.predictions(spark, d).select("id", X.md_to_text(F.col("markdown")).alias("text"))


def _collapse(c: str) -> str:
    return f"replace(replace({c}, repeat(chr(10), 4), repeat(chr(10), 2)), repeat(chr(10), 3), repeat(chr(10), 2))"


@query(
    "cln2_strip_grounding",
    f"""SELECT doc_id, {_collapse("replace(replace(replace(replace(regexp_replace(content, '" + TAG + "', '', 'g'), '\\coloneqq', ':='), '\\eqqcolon', '=:'), '<center>', ''), '</center>', '')")} AS text FROM tagged_output""",
)
def grounding(spark, d):
    return fx.tagged_output(spark, d).select("doc_id", X.strip_grounding(F.col("content"), drop_center=True).alias("text"))


@query(
    "cln3_extract_boxes",
    """SELECT doc_id, label, CAST(floor(v0/999.0::DOUBLE*1000) AS INT) AS x1, CAST(floor(v1/999.0::DOUBLE*1400) AS INT) AS y1, CAST(floor(v2/999.0::DOUBLE*1000) AS INT) AS x2, CAST(floor(v3/999.0::DOUBLE*1400) AS INT) AS y2
    FROM (SELECT doc_id, CASE WHEN i%3=1 THEN 'image' ELSE 'text' END AS label, i*7%500 AS v0, i*11%500 AS v1, 500+i*13%499 AS v2, 500+i*17%499 AS v3 FROM tagged_lines WHERE i%5 <> 4)""",
)
def boxes(spark, d):
    px = lambda i, size: F.floor(F.col("b.box")[i] / 999.0 * size).cast("int")
    rows = fx.tagged_output(spark, d).select("doc_id", F.explode(X.boxes(F.col("content"))).alias("b"))
    return rows.select("doc_id", F.col("b.label").alias("label"), px(0, 1000).alias("x1"), px(1, 1400).alias("y1"), px(2, 1000).alias("x2"), px(3, 1400).alias("y2"))


@query(
    "cln4_image_refs_to_links",
    f"""SELECT doc_id, string_agg(CASE WHEN i%3=1 THEN '![](images/'||doc_id||'_'||((i-1)//3)||'.jpg)'||chr(10) ELSE tag END||chr(10)||x, repeat(chr(10), 3) ORDER BY i)||' \\coloneqq <center>x</center>'||max(tail) AS text
    FROM tagged_lines JOIN (SELECT doc_id, CASE WHEN n_chars < 5000 THEN '{EOS}' ELSE '' END AS tail FROM documents) USING (doc_id) GROUP BY doc_id""",
)
def links(spark, d):
    return fx.tagged_output(spark, d).select("doc_id", X.image_refs_to_links(F.col("content"), F.col("doc_id")).alias("text"))


@query(
    "cln5_clean_formula",
    """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '\\['||trim(x)||'\\]'||CAST(i-1 AS VARCHAR)), chr(10)) AS text FROM documents""",
)
def formulas(spark, d):
    wrapped = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("\\[ "), x, F.lit(" \\quad (eq. "), i.cast("string"), F.lit(") \\]"), i.cast("string")))
    return fx.documents(spark, d).select("doc_id", X.clean_formula(F.array_join(wrapped, "\n")).alias("text"))


@query("cln6_strip_fences", f"SELECT doc_id, {strip('text')} AS text FROM documents")
def fences(spark, d):
    fenced = F.when(F.col("lang") == "en", F.concat(F.lit(" ```markdown\n"), "text", F.lit("\n```\n"))).when(F.col("lang") == "de", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return fx.documents(spark, d).select("doc_id", X.strip_fences(fenced).alias("text"))


@query("cln7_drop_unfinished", f"SELECT doc_id, replace(content, '{EOS}', '') AS content FROM tagged_output WHERE contains(content, '{EOS}')")
def unfinished(spark, d):
    return O.drop_unfinished(fx.tagged_output(spark, d).select("doc_id", "content"))


FINISH = "CASE WHEN n_chars > 4000 THEN 'length' WHEN n_chars < 500 THEN NULL WHEN lang = 'fr' THEN 'content_filter' ELSE 'stop' END"


@query(
    "cln8_normalize_finish",
    f"""SELECT lang, CASE WHEN f = 'length' THEN 'length' WHEN f IS NULL THEN 'fail' ELSE 'stop' END AS finish_reason, count(*) AS n, count(CASE WHEN f IS NULL THEN 1 END) AS n_fail FROM (SELECT lang, {FINISH} AS f FROM documents) GROUP BY 1, 2""",
)
def finish(spark, d):
    rows = fx.table(spark, d, "documents").select("lang", X.normalize_finish(F.expr(FINISH)).alias("finish_reason"))
    return rows.groupBy("lang", "finish_reason").agg(F.count("*").alias("n"), F.count_if(F.col("finish_reason") == "fail").alias("n_fail"))


GRAMS = f"SELECT doc_id, list_filter(list_transform(range(1, len(w)-1), lambda i: w[i:i+2]), lambda g: len(g) = 3) AS g FROM (SELECT doc_id, {word_list('text')} AS w FROM documents)"


@query(
    "cln9_repeated_ngrams",
    f"""WITH e AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1)-1 AS pos FROM ({GRAMS})),
    p AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, g ORDER BY pos) AS prev FROM e),
    h AS (SELECT doc_id, count(*) AS n_repeated FROM p WHERE pos-prev <= 98 AND g[3] NOT IN ('the', 'de') GROUP BY doc_id),
    t AS (SELECT doc_id, CAST(len({word_list('text')}) AS INT) AS n_tokens FROM documents)
    SELECT doc_id, n_tokens, coalesce(n_repeated, 0) AS n_repeated, round(coalesce(n_repeated, 0)/n_tokens::DOUBLE+1e-9, 6) AS rate FROM t LEFT JOIN h USING (doc_id)""",
)
def repeats(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    hits = G.repeated_ngrams(docs, 3, 100, whitelist=("the", "de"))
    return G.repetition_rate(docs, hits).withColumn("rate", r6("rate"))


@query("cln10_file_stem", "SELECT image, 'doc_'||doc_id AS stem, 'archive.tar' AS nested FROM images")
def stems(spark, d):
    im = fx.images(spark, d)
    return im.select("image", X.file_stem(F.col("image")).alias("stem"), X.file_stem(F.concat(F.lit("/a/b."), F.col("doc_id"), F.lit("/archive.tar.gz"))).alias("nested"))


IDS = """SELECT 'doc_'||l_orderkey||'_'||l_linenumber||CASE WHEN l_returnflag='A' THEN '_'||CAST(l_quantity AS INT) ELSE '' END AS id FROM lineitem"""


def _ids(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("doc_"), "l_orderkey", F.lit("_"), "l_linenumber", F.when(F.col("l_returnflag") == "A", F.concat(F.lit("_"), F.col("l_quantity").cast("int"))).otherwise("")).alias("id"))


@query("cln11_strip_shift_suffix", f"SELECT id, regexp_replace(id, '^(.+)_\\d+_\\d+$', '\\1') AS base_id FROM ({IDS})")
def shift_suffix(spark, d):
    return _ids(spark, d).select("id", X.strip_shift_suffix(F.col("id")).alias("base_id"))


@query(
    "cln12_parse_suffix",
    f"SELECT id, regexp_replace(id, '^(.*)_\\d+$', '\\1') AS base, coalesce(TRY_CAST(regexp_extract(id, '_(\\d+)$', 1) AS INT), -1) AS suffix FROM (SELECT replace(id, '_1_', '_x') AS id FROM ({IDS}))",
)
def suffix(spark, d):
    ids = _ids(spark, d).select(F.replace(F.col("id"), F.lit("_1_"), F.lit("_x")).alias("id"))
    return ids.select("id", X.suffix_base(F.col("id")).alias("base"), X.suffix_number(F.col("id")).alias("suffix"))


@query(
    "cln13_parse_width_size",
    f"""SELECT id, CAST(regexp_extract(id, '^(.+)_(\\d+)_(\\d+)$', 2) AS INT) AS w, CAST(regexp_extract(id, '^(.+)_(\\d+)_(\\d+)$', 3) AS INT) AS h, CAST(regexp_extract(id, '_(\\d+)$', 1) AS INT) AS width
    FROM ({IDS}) WHERE regexp_matches(id, '^(.+)_(\\d+)_(\\d+)$')""",
)
def sizes(spark, d):
    return X.parse_size(_ids(spark, d)).select("id", "w", "h", X.parse_width(F.col("id")).alias("width"))


@query("cln14_block_code", "SELECT p_partkey, 'C'||CASE WHEN regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g')='' THEN 'X' ELSE regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g') END||'B'||p_size AS code, 'CXB1' AS blank FROM part")
def codes(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", X.block_code(F.col("p_brand"), F.col("p_size")).alias("code"), X.block_code(F.lit("#!"), F.lit(1)).alias("blank"))


@query(
    "cln15_group_id",
    "SELECT 'R='||resolution||'|fs='||font_size||'|ls='||line_spacing||'.5|cs='||letter_spacing AS gid, 'fs='||font_size||'|ls='||line_spacing||'|cs='||letter_spacing AS sid, count(*) AS n FROM analysis_points GROUP BY ALL",
)
def group_ids(spark, d):
    pts = fx.analysis_points(spark, d)
    gid = X.group_id(F.col("resolution"), F.col("font_size"), F.col("line_spacing") + 0.5, F.col("letter_spacing"))
    return pts.groupBy("resolution", "font_size", "line_spacing", "letter_spacing").agg(F.count("*").alias("n")).select(
        gid.alias("gid"), X.style_id(F.col("font_size"), F.col("line_spacing"), F.col("letter_spacing")).alias("sid"), "n"
    )


@query(
    "cln16_text_token_len",
    "SELECT doc_id, CAST(length(text) AS INT) AS text_len, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS INT) AS token_len, CAST(coalesce(length(CASE WHEN lang <> 'es' THEN text END), 0) AS INT) AS len_or_0 FROM documents",
)
def lengths(spark, d):
    t = F.col("text")
    return fx.documents(spark, d).select("doc_id", X.text_len(t).alias("text_len"), X.token_len(t).alias("token_len"), X.text_len(F.when(F.col("lang") != "es", t)).alias("len_or_0"))
