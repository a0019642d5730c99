"""Line dedup by a log-template tree: lines that recur over different documents, up to variable fields, go but for the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale.session import cut_lineage, discard, release_shuffles, spread

DEPTH = 3
MIN_TOKENS = 5
MIN_CHARS = 24
MIN_DOCS = 3
LONG_TOKENS = 50
COPY = 0.8
SHINGLE = 5
SIMILAR = 0.7
CONSTANT = 0.5
SPACE = r"[\x20\x09-\x0D]+"
FIELD = "<*>"


def line_tokens(line: Column) -> Column:
    """Words between ASCII white space; words with a digit are a variable field."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*", FIELD)).otherwise(line)
    return F.filter(F.split(masked, SPACE), lambda x: x != "")


def leaf_of(tokens: Column) -> Column:
    """The place of a line in the tree: its number of words and its first DEPTH words."""
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH))


def words_of(text: Column) -> Column:
    """Words between ASCII white space, in lower case."""
    return F.filter(F.split(F.lower(text), SPACE), lambda x: x != "")


def runs(words: Column, n: int) -> Column:
    """The different runs of n words, as hashes; a shorter list is one run."""
    # through a list of one, so that the words are made once and not for every run
    of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))
    return F.array_distinct(F.get(F.transform(F.array(words), of), F.lit(0)))


def copies(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_doc, _top): the pairs of texts where the first is a near copy of the second.

    It is one if they have COPY of their runs of SHINGLE words in common, and no line of the first is its own: every
    line of at least MIN_TOKENS words has half of its word pairs in the second. An edited line has, a new line has not.
    """
    asked = pairs.select(F.explode(F.array("_doc", "_top")).alias("_d")).distinct()
    texts = lines.join(asked, F.col("_doc") == F.col("_d"), "left_semi").groupBy("_doc").agg(F.first("_lines").alias("_lines"))
    texts = cut_lineage(spread(texts, "_doc").withColumn("_runs", runs(words_of(F.concat_ws("\n", "_lines")), SHINGLE)), "line-texts")
    near = pairs.join(texts.select("_doc", F.col("_runs").alias("_a")), "_doc").join(texts.select(F.col("_doc").alias("_top"), F.col("_runs").alias("_b")), "_top")
    near = near.withColumn("_both", F.size(F.array_intersect("_a", "_b"))).where(F.col("_both") >= COPY * (F.size("_a") + F.size("_b") - F.col("_both"))).select("_doc", "_top")
    near = near.join(texts.select("_doc", F.col("_lines").alias("_a")), "_doc").join(texts.select(F.col("_doc").alias("_top"), F.col("_lines").alias("_b")), "_top")
    left = F.filter(F.transform(F.array_except("_a", "_b"), words_of), lambda x: F.size(x) >= MIN_TOKENS)
    own = lambda h: F.exists(F.transform(left, lambda x: runs(x, 2)), lambda x: 2 * F.size(F.array_intersect(x, h)) < F.size(x))
    found = cut_lineage(near.where(~F.exists(F.array(runs(words_of(F.concat_ws("\n", "_b")), 2)), own)).select("_doc", "_top"), "line-copies")
    discard(texts)
    return found


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(_id, _doc, numbers): by document and 64-bit hash of its text, the numbers of the lines to drop."""
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_doc"), F.split(text, "\n", -1).alias("_lines")).where(text.isNotNull())
    parts = F.transform("_lines", lambda x: line_tokens(x))
    leaves = lines.select("_id", "_doc", F.transform(F.arrays_zip(F.col("_lines").alias("line"), parts.alias("tokens")), lambda x: F.struct(leaf_of(x["tokens"]).alias("leaf"), F.size(x["tokens"]).alias("n"), F.length(x["line"]).alias("chars"))).alias("_l"))
    leaves = leaves.withColumn("_size", F.aggregate("_l", F.lit(0), lambda s, x: s + x["n"]))
    keys = ["_id", "_doc", "_size"]
    # outer, though no list is empty: else Spark asks for the list's size first and parses every line once more for it
    rows = leaves.select(*keys, F.posexplode_outer("_l").alias("_no", "_x")).where((F.col("_x.n") >= MIN_TOKENS) & (F.col("_x.chars") >= MIN_CHARS)).select(*keys, "_no", F.col("_x.leaf").alias("leaf"))
    rows = cut_lineage(rows, "line-leaves")
    # a leaf can only recur where it has different texts, so most lines are done here, without their words
    many = rows.groupBy("leaf").agg(F.min("_doc").alias("low"), F.max("_doc").alias("high")).where("low < high").select("leaf")
    asked = rows.join(many, "leaf").groupBy("_id", "_doc").agg(F.first("_size").alias("_size"), F.collect_set("_no").alias("_nos"))
    asked = asked.withColumnRenamed("_id", "_i").withColumnRenamed("_doc", "_d")
    found = lines.join(asked, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_doc") == F.col("_d")))
    found = found.select(*keys, F.explode_outer(F.transform("_nos", lambda i: F.struct(i.alias("no"), line_tokens(F.get(F.col("_lines"), i)).alias("tokens")))).alias("_x"))
    found = found.select(*keys, F.col("_x.no").alias("_no"), F.col("_x.tokens").alias("tokens"))
    found = cut_lineage(found.withColumn("leaf", leaf_of(F.col("tokens"))).withColumn("exact", F.xxhash64("tokens")), "line-words")
    discard(rows)
    release_shuffles(docs.sparkSession)
    kinds = cut_lineage(found.groupBy("leaf", "exact").agg(F.count("*").alias("w"), F.first("tokens").alias("tokens")), "line-kinds")
    several = kinds.groupBy("leaf").agg(F.min("exact").alias("low"), F.max("exact").alias("high"), F.sum("w").alias("total")).where("low < high").select("leaf", "total")
    words = kinds.join(several, "leaf").select("leaf", "total", "w", F.posexplode("tokens").alias("pos", "token"))
    counted = words.groupBy("leaf", "total", "pos", "token").agg(F.sum("w").alias("w"))
    most = counted.groupBy("leaf", "total", "pos").agg(F.max(F.struct("w", "token")).alias("top"))
    word = F.when(F.col("top.w") >= CONSTANT * F.col("total"), F.col("top.token"))
    trees = most.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("word")))), lambda x: x["word"]).alias("template"))
    same = F.aggregate(F.zip_with("tokens", "template", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    fits = F.coalesce(same >= SIMILAR * F.size("tokens"), F.lit(False))
    # a long line is a template of its own, too
    long = F.size("tokens") >= LONG_TOKENS
    own = F.struct(F.xxhash64(F.lit("own"), "exact").alias("template"), F.when(long, 2).otherwise(F.lit(min_docs)).alias("least"))
    shared = F.struct(F.col("leaf").alias("template"), F.lit(min_docs).alias("least"))
    named = kinds.join(trees, "leaf", "left").select("leaf", "exact", F.when(fits & long, F.array(shared, own)).when(fits, F.array(shared)).otherwise(F.array(own)).alias("_t"))
    marked = found.drop("tokens").join(named, ["leaf", "exact"]).drop("leaf", "exact").select(*keys, "_no", F.explode_outer("_t").alias("_t")).select(*keys, "_no", "_t.*")
    marked = cut_lineage(marked, "line-templates")
    discard(found)
    discard(kinds)
    release_shuffles(docs.sparkSession)
    top = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_doc", "_size")))
    held = marked.groupBy("template").agg(F.count_distinct("_doc").alias("docs"), F.max("least").alias("least"), top.alias("top")).where("docs >= least")
    held = held.select("template", F.col("top._id").alias("first"), F.col("top._doc").alias("_top"), F.col("top._size").alias("_top_size"))
    others = marked.join(held, "template").where(~F.col("_id").eqNullSafe(F.col("first")) & (F.col("_doc") != F.col("_top")))
    others = cut_lineage(others.select("template", "least", *keys, "_no", "_top", "_top_size"), "line-others")
    discard(marked)
    alike = F.least("_size", "_top_size") >= COPY * F.greatest("_size", "_top_size")
    others = others.join(copies(lines, others.where(alike).select("_doc", "_top").distinct()), ["_doc", "_top"], "left_anti")
    release_shuffles(docs.sparkSession)
    enough = others.groupBy("template", "least").agg(F.count_distinct("_doc").alias("docs")).where("docs + 1 >= least").select("template")
    return others.join(enough, "template").groupBy("_id", "_doc").agg(F.collect_set("_no").alias("numbers"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row, its text without recurring lines; `lines` and `dropped` count them (columns of these names are replaced).

    Lines of at least MIN_TOKENS words and MIN_CHARS characters are parsed into a tree by word count and first words.
    In a leaf, positions where one word has half of the lines are constant, the others variable; a line that has
    SIMILAR of its words from the constants belongs to the leaf's template, any other line is a template of its own.
    The document with the smallest id keeps its line. Copies and near copies of it (`copies`) are for near-duplicate
    detection: they keep the line and do not count. All others lose it if they and the first are `min_docs` different
    texts; for a line of LONG_TOKENS words that is repeated word by word, two are enough.

    Other lines, their order and line ends stay.
    Null texts stay null, with 0 lines. Rows without an id lose recurring lines. Repeated rows are treated alike. A
    table without rows stays empty. All work is done in DataFrame functions; only lines in leaves of several documents
    are read by word.
    """
    own = [c for c in docs.columns if c.lower() not in ("lines", "dropped", "_i", "_d", "numbers")]
    found = recurring(docs, id_col, text_col, min_docs).withColumnRenamed("_id", "_i").withColumnRenamed("_doc", "_d")
    out = docs.select(*[F.col(f"`{c}`") for c in own]).join(found, F.col(id_col).eqNullSafe(F.col("_i")) & (F.xxhash64(F.col(text_col)) == F.col("_d")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.concat_ws("\n", F.filter(parts, lambda x, i: ~F.array_contains(F.col("numbers"), i)))
    text = F.when(F.col("numbers").isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    cols = [text if c == text_col else F.col(f"`{c}`") for c in own]
    return out.select(*cols, F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.when(F.col("numbers").isNotNull(), F.size("numbers")), F.lit(0)).cast("long").alias("dropped"))
