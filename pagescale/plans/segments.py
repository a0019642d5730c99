"""Queries on cutting books into chapters, pages and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import text as X
from pagescale.operators import segmentation as O
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query
from pagescale.plans.oracles import WS, strip, word_list

NORM = f"trim(regexp_replace(text, '\\s+', ' ', 'g'))"
SENTENCES = "list_filter(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1'||chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(
    "seg1_split_chapters",
    rf"""SELECT book_name, chapter_id, body FROM (
      SELECT book_name, CASE mark WHEN 'IV' THEN '4' WHEN 'XIX' THEN '19' WHEN 'MCM' THEN '1900' ELSE mark END AS chapter_id, {strip('raw')} AS body FROM (
        SELECT book_name, split_part(part, chr(2), 1) AS mark, split_part(part, chr(2), 2) AS raw FROM (
          SELECT book_name, unnest(string_split(regexp_replace(text, '(?m)^\s*CHAPTER\s+([A-Z0-9]+)[^\r\n]*', chr(1)||'\1'||chr(2), 'g'), chr(1))[2:]) AS part FROM book_chapter)))
    WHERE body <> ''""",
)
def chapters(spark, d):
    return O.chapters(fx.books(spark, d, "chapter")).select("book_name", "chapter_id", "body")


@query(
    "seg1_numbered_chapters",
    rf"""SELECT book_name, chapter_id, body FROM (SELECT book_name, split_part(part, chr(2), 1) AS chapter_id, {strip('split_part(part, chr(2), 2)')} AS body FROM (
      SELECT book_name, unnest(string_split(regexp_replace(text, '(?mi)^\s*Chapter\s+(\d+)\s*:[^\r\n]*', chr(1)||'\1'||chr(2), 'g'), chr(1))[2:]) AS part FROM book_numbered)) WHERE body <> ''""",
)
def numbered(spark, d):
    return O.chapters(fx.books(spark, d, "numbered"), marker=C.NUMBERED_MARKER).select("book_name", "chapter_id", "body")


@query(
    "seg2_split_headed_chapters",
    rf"""WITH ls AS (SELECT book_name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM book_headed),
    f AS (SELECT *, regexp_matches(line, '(?i)^\s*CHAPTER\s+([IVXLCDM]+|\d+)\.\s*$') AS mark, upper(line) = line AS caps FROM ls),
    g AS (SELECT *, sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY book_name ORDER BY pos) AS ch FROM f),
    b AS (SELECT *, min(CASE WHEN NOT mark AND NOT caps THEN pos END) OVER (PARTITION BY book_name, ch) AS first_pos FROM g WHERE ch > 0),
    t AS (SELECT book_name, ch, {strip("string_agg(line, chr(10) ORDER BY pos)")} AS body FROM b WHERE NOT mark AND pos >= first_pos GROUP BY ALL)
    SELECT book_name, CAST(row_number() OVER (PARTITION BY book_name ORDER BY ch) AS VARCHAR) AS section_id, body FROM t WHERE body <> ''""",
)
def headed(spark, d):
    return O.sections(fx.books(spark, d, "headed"), X.split_headed_chapters(F.col("text"))).select("book_name", "section_id", "body")


@query(
    "seg3_split_by_separator",
    rf"""WITH ls AS (SELECT book_name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM book_separator),
    g AS (SELECT *, regexp_matches(line, '^\s*-{{5,}}\s*$') AS sep, sum(CASE WHEN regexp_matches(line, '^\s*-{{5,}}\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY book_name ORDER BY pos) AS sec FROM ls),
    t AS (SELECT book_name, sec, {strip("string_agg(line, chr(10) ORDER BY pos)")} AS body FROM g WHERE NOT sep GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY book_name ORDER BY sec) AS rn FROM t WHERE body <> '')
    SELECT book_name, CAST(rn-3 AS VARCHAR) AS section_id, body FROM n WHERE rn > 3""",
)
def separated(spark, d):
    return O.sections(fx.books(spark, d, "separator"), X.split_by_separator(F.col("text"))).select("book_name", "section_id", "body")


@query(
    "seg4_extract_delimited",
    rf"""WITH ls AS (SELECT book_name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM book_letter),
    m AS (SELECT *, regexp_matches(line, '(?i)^\s*_Dear\s+Pierrepont:_') AS st, lower(trim(line)) = 'your affectionate father,' AND lower(trim(lead(line) OVER (PARTITION BY book_name ORDER BY pos))) = 'john graham.' AS en FROM ls),
    e AS (SELECT *, min(CASE WHEN en THEN pos+1 END) OVER (PARTITION BY book_name ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM m),
    s AS (SELECT book_name, pos AS a, coalesce(stop, 2147483647) AS z FROM e WHERE st),
    o AS (SELECT *, max(z) OVER (PARTITION BY book_name ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    t AS (SELECT o.book_name, a, {strip("string_agg(line, chr(10) ORDER BY pos)")} AS body FROM o JOIN ls ON o.book_name = ls.book_name AND pos BETWEEN a AND z WHERE before IS NULL OR a > before GROUP BY ALL)
    SELECT book_name, CAST(row_number() OVER (PARTITION BY book_name ORDER BY a) AS VARCHAR) AS section_id, body FROM t""",
)
def letters(spark, d):
    return O.sections(fx.books(spark, d, "letter"), X.extract_delimited(F.col("text"))).select("book_name", "section_id", "body")


def _roman_spelling(n):
    """Spell a number below 4000 in Roman numerals from its digits."""
    digits = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    place = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (F.floor(n / k) % 10 + 1).cast("int"))
    return F.concat(place(1000, ["", "M", "MM", "MMM"] + [""] * 6), place(100, digits("C", "D", "M")), place(10, digits("X", "L", "C")), place(1, digits("I", "V", "X")))


@query("seg5_roman_to_int", "SELECT o_orderkey, CAST(1 + o_orderkey % 3999 AS INT) AS number FROM orders")
def roman(spark, d):
    orders = fx.table(spark, d, "orders")
    spelled = F.when(F.col("o_orderkey") % 2 == 0, _roman_spelling(1 + F.col("o_orderkey") % 3999)).otherwise(F.lower(_roman_spelling(1 + F.col("o_orderkey") % 3999)))
    return orders.select("o_orderkey", X.roman_to_int(spelled).alias("number"))


@query("seg6_normalize_ws", f"SELECT doc_id, {NORM} AS text FROM documents")
def norm(spark, d):
    return fx.documents(spark, d).select("doc_id", X.normalize_ws(F.col("text")).alias("text"))


@query("seg7_split_sentences", f"SELECT doc_id, pos, s FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1)-1 AS pos FROM (SELECT doc_id, {SENTENCES.format(NORM)} AS l FROM documents))")
def sentences(spark, d):
    parts = X.split_sentences(X.normalize_ws(F.col("text")))
    return fx.documents(spark, d).select("doc_id", F.posexplode(parts).alias("pos", "s"))


def chunk_sql(measure: str, forced: str, n: int) -> str:
    """Greedy chunking as a recursive walk over the sentences of every document."""
    return f"""WITH RECURSIVE s AS (SELECT doc_id, {SENTENCES.format(NORM)} AS l FROM documents),
    e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos, len(l) AS m FROM s),
    w AS (SELECT *, {measure} AS w, sum({measure}) OVER (PARTITION BY doc_id) AS total FROM e),
    walk AS (
      SELECT doc_id, pos, 0 AS closed, CAST(0 AS HUGEINT) AS filled, 0 AS block FROM (SELECT DISTINCT doc_id, 0 AS pos FROM w)
      UNION ALL
      SELECT doc_id, pos, CASE WHEN cut THEN closed+1 ELSE closed END, CASE WHEN cut THEN 0 ELSE filled END, closed AS block FROM (
        SELECT w.doc_id, w.pos, walk.closed, walk.filled + w.w AS filled, ({n}-walk.closed-1) > 0 AND ((m-w.pos) {forced} ({n}-walk.closed-1) OR ((m-w.pos) > ({n}-walk.closed-1) AND (walk.filled+w.w)*{n} >= total)) AS cut
        FROM walk JOIN w ON w.doc_id = walk.doc_id AND w.pos = walk.pos+1)),
    g AS (SELECT walk.doc_id, block, string_agg(t, ' ' ORDER BY w.pos) AS text FROM walk JOIN w ON w.doc_id = walk.doc_id AND w.pos = walk.pos GROUP BY ALL),
    k AS (SELECT doc_id, unnest(range(0, {n})) AS block FROM documents)
    SELECT k.doc_id, CAST(k.block AS INT) AS block, coalesce(g.text, '') AS text FROM k LEFT JOIN g USING (doc_id, block)"""


@query("seg8_chunk_by_chars", chunk_sql("length(t)", "=", 4))
def by_chars(spark, d):
    return fx.documents(spark, d).select("doc_id", F.posexplode(X.chunk_by_chars(X.split_sentences(X.normalize_ws(F.col("text"))), 4)).alias("block", "text"))


@query("seg9_chunk_by_words", chunk_sql(f"len({word_list('t')})", "<=", 6))
def by_words(spark, d):
    return fx.documents(spark, d).select("doc_id", F.posexplode(X.chunk_by_words(X.split_sentences(X.normalize_ws(F.col("text"))), 6)).alias("block", "text"))


def _paged(spark, d, form, bodies, **kw):
    pages = O.paginate(fx.books(spark, d, form), bodies, **kw)
    return pages.select("book_name", "page_id", F.array_join("blocks", "|").alias("blocks"))


@query("seg10_paginate_numbered")
def paginate_numbered(spark, d):
    """Reference length from the first chapter, six pages per virtual chapter."""
    bodies = F.transform(X.split_chapters(F.col("text"), C.NUMBERED_MARKER), lambda c: c["body"])
    return _paged(spark, d, "numbered", bodies, ref_index=0, needs_more_than=0)


@query("seg10_paginate_headed")
def paginate_headed(spark, d):
    """Reference length from the third chapter where there are more than two."""
    return _paged(spark, d, "headed", X.split_headed_chapters(F.col("text")), ref_index=2, needs_more_than=2)


@query("seg10_paginate_flat")
def paginate_flat(spark, d):
    """Reference length from the second chapter, no page level."""
    return _paged(spark, d, "headed", X.split_headed_chapters(F.col("text")), ref_index=1, needs_more_than=1, chunk_num=1)


def _blocks(spark, d):
    """Four sentence blocks per document, keyed by source and document."""
    return fx.documents(spark, d).select(
        F.col("source").alias("book_name"), F.col("doc_id").cast("string").alias("page_id"),
        X.chunk_by_chars(X.split_sentences(X.normalize_ws(F.col("text"))), 4).alias("blocks"),
    )


SEGMENT = lambda i, k: f"array_to_string(w[1+{i}*(len(w)//{k})+least({i}, len(w)%{k}):({i}+1)*(len(w)//{k})+least({i}+1, len(w)%{k})], ' ')"
WORDS = f"SELECT doc_id, lang, {word_list('text')} AS w FROM documents"


@query("seg11_to_wide_blocks", f"SELECT doc_id, {', '.join(SEGMENT(i, 4) + f' AS block{i + 1}' for i in range(4))}, '' AS block5 FROM ({WORDS})")
def wide(spark, d):
    df = fx.documents(spark, d).select("doc_id", X.equal_word_segments(F.col("text"), 4).alias("blocks"))
    return O.to_wide_blocks(df, 5)


@query(
    "seg12_unpivot_blocks",
    f"""SELECT doc_id, block_no, doc_id||'_block'||block_no AS block_key, text FROM ({' UNION ALL '.join(f'SELECT doc_id, {i + 1} AS block_no, {SEGMENT(i, 12)} AS text FROM ({WORDS})' for i in range(12))}) WHERE text <> ''""",
)
def unpivot(spark, d):
    df = fx.documents(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("page_id"), X.equal_word_segments(F.col("text"), 12).alias("blocks"))
    return O.unpivot_blocks(O.to_wide_blocks(df, 12), ["doc_id", "page_id"]).drop("page_id")


@query(
    "seg13_group_blocks_by_page",
    f"""SELECT lang AS page_id, CAST(doc_id AS VARCHAR) AS book_name, block_no, text FROM ({' UNION ALL '.join(f'SELECT doc_id, lang, {i + 1} AS block_no, {SEGMENT(i, 3)} AS text FROM ({WORDS})' for i in range(3))}) WHERE text <> ''""",
)
def by_page(spark, d):
    """The language stands for the page, so that a few pages hold very many records."""
    df = fx.documents(spark, d).select(F.col("lang").alias("page_id"), F.col("doc_id").cast("string").alias("book_name"), X.equal_word_segments(F.col("text"), 3).alias("blocks"))
    return O.group_blocks_by_page(O.unpivot_blocks(O.to_wide_blocks(df, 3), ["page_id", "book_name"]))


@query("seg14_equal_word_segments", f"SELECT doc_id, seg, text FROM ({' UNION ALL '.join(f'SELECT doc_id, {i} AS seg, {SEGMENT(i, 5)} AS text FROM ({WORDS})' for i in range(5))})")
def equal_segments(spark, d):
    return fx.documents(spark, d).select("doc_id", F.posexplode(X.equal_word_segments(F.col("text"), 5)).alias("seg", "text"))


@query(
    "seg15_segment_combinations",
    f"""WITH p AS (SELECT doc_id, [{', '.join(SEGMENT(i, 5) for i in range(5))}] AS s FROM ({WORDS})),
    m AS (SELECT list_filter([0,1,2,3,4], lambda i: (mask >> i) & 1 = 1) AS idx FROM range(1, 32) t(mask)),
    n AS (SELECT idx, len(idx) AS n_segments, row_number() OVER (PARTITION BY len(idx) ORDER BY idx) AS combo_idx FROM m)
    SELECT doc_id, CAST(n_segments AS INT) AS n_segments, CAST(combo_idx AS INT) AS combo_idx, array_to_string(list_filter(list_transform(idx, lambda i: s[i+1]), lambda t: t <> ''), ' ') AS text FROM p, n""",
)
def combinations(spark, d):
    df = fx.documents(spark, d).select("doc_id", X.equal_word_segments(F.col("text"), 5).alias("segments"))
    return O.segment_combinations(df)


@query("seg16_wrap_lines")
def wrap(spark, d):
    lines = X.wrap_lines(F.col("text"), 60)
    return fx.documents(spark, d).select("doc_id", lines.alias("ls")).select(
        "doc_id", F.size("ls").alias("n_lines"), F.array_max(F.transform("ls", lambda x: F.length(x))).alias("longest"), F.array_join("ls", "\n").alias("wrapped")
    )


@query(
    "seg17_page_concat",
    """SELECT conv_id AS doc_id, turn AS page, text||chr(10)||chr(10)||'<--- Page Split --->'||chr(10) AS piece FROM conversations WHERE text IS NOT NULL""",
)
def concat_pages(spark, d):
    pages = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("text").alias("content"))
    return O.page_concat(pages)
