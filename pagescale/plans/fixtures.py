"""Evaluation inputs derived from the given tables; each function has its equal in ``oracles.VIEWS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import geometry as G
from pagescale.functions import text as X
from pagescale.session import spread_few, table

BLOCK = 400
# Gate parameters used to derive measurements.
GATE_W0 = {512: -45.5724119331014, 640: -46.13850916228606, 1024: -46.23202179601734, 1280: -42.99133143004373}
GATE_A = 2.91046860622506
GATE_ALPHA = 5.534691214157865


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_few(table(spark, sf_dir, "documents"), "doc_id")


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into blocks of 400 characters with a recognised text: misread letters, some cut short."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", X.normalize_ws(F.col("text")).alias("t"))
    pieces = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))  # whole pieces leave the row, never the text
    g = docs.select("doc_id", "lang", "source", F.posexplode(pieces).alias("block", "ground_truth"))
    share = F.when((F.col("doc_id") * 31 + F.col("block") * 7) % 5 == 0, 40 + (F.col("doc_id") + F.col("block") * 7) % 41).otherwise(100)
    seen = F.substring("ground_truth", F.lit(1), F.floor(F.length("ground_truth") * share / 100).cast("int"))
    return g.select(
        F.concat_ws("_", F.lit("doc"), "doc_id", "block").alias("id"), "doc_id", "block", "lang", "source", "ground_truth",
        F.replace(F.replace(seen, F.lit("the"), F.lit("tbe")), F.lit("io"), F.lit("lo")).alias("prediction"),
    )


def analysis_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every document in every style and resolution, with hash-like noise from integer arithmetic."""
    docs = documents(spark, sf_dir).select("doc_id", (F.col("n_chars") * 4).alias("text_len"))
    grid = docs
    for name, values in (("font_size", C.FONT_SIZES), ("line_spacing", C.LINE_SPACINGS), ("letter_spacing", C.LETTER_SPACINGS), ("resolution", C.RESOLUTIONS)):
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    grid = grid.withColumn("character_width", G.font_width(F.col("font_size"))).withColumn("character_height", G.font_height(F.col("font_size")))
    sidx = F.col("font_size") * 100 + F.col("line_spacing") * 10 + F.col("letter_spacing") + 1
    w0 = F.element_at(F.create_map(*[F.lit(x) for kv in GATE_W0.items() for x in kv]), F.col("resolution"))
    length, res = F.col("text_len").cast("double"), F.col("resolution").cast("double")
    cell = (F.col("character_width") + F.col("letter_spacing")) * length / (F.col("character_height") + F.col("line_spacing"))
    z = w0 + F.lit(GATE_A) * F.ln(cell) + F.lit(GATE_ALPHA) * F.ln(length / F.pow(res / 64.0, F.lit(2.0)))
    u = ((F.col("doc_id") * 7919 + sidx * 104729 + F.col("resolution") * 31) % 1000) / 1000.0
    u2 = ((F.col("doc_id") * 611953 + sidx * 7907 + F.col("resolution") * 17) % 997) / 997.0
    error = F.when(u2 < 1.0 / (1.0 + F.exp(-z)), F.least(F.lit(0.999), 0.62 + 0.33 * u)).otherwise(0.0608 * u)
    return grid.select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("image_id"), "font_size", "line_spacing", "letter_spacing", "resolution",
        F.col("text_len").cast("int").alias("text_len"), F.floor(F.col("text_len") / 4).cast("int").alias("token_len"),
        "character_width", "character_height", (256.0 * length / (res * res)).alias("patch_density"), F.round(error, 6).alias("edit_distance"),
    )


def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document at every resolution in the baseline style."""
    pts = analysis_points(spark, sf_dir).where((F.col("font_size") == 28) & (F.col("line_spacing") == 6) & (F.col("letter_spacing") == 0))
    return pts.select(F.col("image_id").alias("id"), "resolution", "text_len", F.col("token_len").alias("text_token_len"), F.col("edit_distance").alias("edit_dist"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per document with a size that follows its length."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("pages/doc_"), F.col("doc_id"), F.lit(".png")).alias("image"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), "doc_id", "n_chars",
        (300 + (F.col("n_chars") * 3) % 4000).cast("int").alias("width"), (400 + (F.col("n_chars") * 7) % 3900).cast("int").alias("height"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth exists for labelled documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.select(
        F.concat(F.lit("gt/doc_"), F.col("doc_id"), F.lit(".jpg")).alias("image"), F.col("text").alias("gt"), F.col("doc_id").alias("pos"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("text_token_len"), F.col("n_chars").cast("int").alias("text_len"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised Markdown exists for documents that share their number with a crawled page."""
    d = table(spark, sf_dir, "documents")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    md = F.concat(F.lit("# "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n- ")), F.lit("\n![fig](images/0.jpg) [link](http://x.y/z)"))
    return d.join(p, "doc_id", "left_semi").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), md.alias("markdown"))


def books(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """One book per source document: its lines with the markers of a book form before every third line."""
    d = documents(spark, sf_dir)
    ls = F.split("text", "\n")
    head = {
        "chapter": lambda i: F.concat(F.lit("  CHAPTER "), F.element_at(F.array(*map(F.lit, ["IV", "12", "A1", "XIX", "MCM"])), (F.floor(i / 3) % 5 + 1).cast("int")), F.lit(". Of things\n")),
        "numbered": lambda i: F.concat(F.lit("chapter "), (F.floor(i / 3) + 1).cast("string"), F.lit(" : Title\n")),
        "headed": lambda i: F.concat(F.lit("Chapter "), (F.floor(i / 3) + 1).cast("string"), F.lit(".\n\nOF THE TITLE\n\n")),
        "separator": lambda i: F.lit("\n  ------- \n"),
        "letter": lambda i: F.when(F.floor(i / 3) % 2 == 0, F.lit("_Dear Pierrepont:_ ")).otherwise(F.lit("Your affectionate father,\nJOHN GRAHAM.\n")),
    }[form]
    marked = F.transform(ls, lambda x, i: F.when(i % 3 == 0, F.concat(head(i), x)).otherwise(x))
    return d.select("doc_id", F.concat(F.lit("book_"), F.col("doc_id")).alias("book_name"), F.array_join(marked, "\n").alias("text"))


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document: its lines as layout blocks, with truncation links between some neighbours."""
    d = documents(spark, sf_dir)
    width, height = 1600, 2200
    cat = F.array(*map(F.lit, ["title", "text_block", "Text_Block", "figure_caption", "text_block", "page_number", "text_block"]))

    def block(x, i):
        x0, y0 = 40.5 + (i * 13) % 50, 30.25 + (i * 97) % 2000
        x1, y1 = x0 + 200.0 + (F.length(x) % 900), y0 + 60.0
        poly = F.array(x0, y0, x1, y0, x1, y1, x0, y1)
        return F.struct(
            i.alias("anno_id"), F.element_at(cat, ((i + F.col("doc_id")) % 7 + 1).cast("int")).alias("category_type"),
            F.when(i % 11 != 10, ((i * 5) % 7 + i).cast("int")).alias("order"), (i % 6 == 5).alias("ignore"),
            F.when(i % 9 != 8, poly).alias("poly"), x.alias("text"),
        )

    ls = F.split("text", "\n")
    rel = lambda a, b, t: F.struct(t.alias("relation_type"), a.cast("int").alias("source_anno_id"), b.cast("int").alias("target_anno_id"))
    links = F.transform(ls, lambda x, i: rel(i, i + 1 + i % 2, F.when(i % 4 == 0, "truncated").when(i % 4 == 1, "truncated").otherwise("parent_son")))
    return d.select(
        F.col("doc_id").alias("page_id"), F.concat(F.when(F.col("lang") == "en", "newspaper_").otherwise("book_"), F.col("source"), F.lit("_"), F.col("doc_id"), F.lit(".jpg")).alias("image_path"),
        F.lit(width).alias("width"), F.lit(height).alias("height"), F.transform(ls, block).alias("layout_dets"), links.alias("relations"),
    )


def tagged_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised pages with location tags before every line; long pages end without the end token."""
    d = documents(spark, sf_dir)
    tag = lambda i: F.concat(
        F.lit("<|ref|>"), F.when(i % 3 == 1, "image").otherwise("text"), F.lit("<|/ref|><|det|>[["), (i * 7 % 500).cast("string"), F.lit(", "), (i * 11 % 500).cast("string"),
        F.lit(", "), (500 + i * 13 % 499).cast("string"), F.lit(", "), F.when(i % 5 == 4, F.lit("x")).otherwise((500 + i * 17 % 499).cast("string")), F.lit("]]<|/det|>"),
    )
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(tag(i), F.lit("\n"), x)), "\n\n\n")
    end = F.when(F.col("n_chars") < 5000, F.lit(C.END_TOKEN)).otherwise("")
    return d.select("doc_id", (F.col("doc_id") % 50).alias("pdf"), "n_chars", F.concat(body, F.lit(" \\coloneqq <center>x</center>"), end).alias("content"))
