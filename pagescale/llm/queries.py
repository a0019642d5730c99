"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.llm import collocations, curriculum, dual_tree, html_pages, language, latent, line_templates, media, setsketch, topk_search, toxicity, warc, weak_labels
from pagescale.llm.common import fold
from pagescale.llm.registry import query
from pagescale.session import table

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('7/' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CASE rk % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope FROM r),
l AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM w),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM l),
t AS (SELECT source, source_size, slope, least(cap, weight * max(lv) OVER ()) AS target FROM f),
c AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, slope,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM c),
g AS (SELECT *, CAST(whole * size + greatest(0, least(size, floor(target - whole * source_size) - before)) AS BIGINT) AS taken FROM e),
h AS (SELECT *, CASE WHEN taken > 0 THEN least(1.0, before / target) END AS u FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, taken,
       round(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 9) AS position
FROM h
"""


@query("op10_curriculum_mix", MIX_SQL)
def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    narrow = docs.select("doc_id", "source", curriculum.n_words(F.col("text")).alias("size"))
    planned = curriculum.plan(narrow, text_col=None)
    return planned.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round(curriculum.position(F.lit(0)), 9).alias("position"))


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""


@query("op3_warc_round_trip", WARC_SQL)
def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


@query("op9_media_columns")
def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tile")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id"), language.FOLDS) == language.HELD_OUT, F.lit(False))
    predicted = language.predict(docs.select("doc_id", "text"), language.train(spark, docs))
    return predicted.select("doc_id", held.alias("held_out"), "lang_pred", "score")


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS sh FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM w UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query("op5_setsketch_near_dedup", NEAR_SQL)
def op5_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


@query("op6_latent_decontamination")
def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = latent.contaminations(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.round(F.max("matched"), 6).alias("matched"))
    none = F.array().cast("array<bigint>")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("matched", F.lit(0.0)).alias("matched"))


@query("op2_line_templates")
def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs).select("doc_id", "text", "lines", "dropped")


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), html_pages.train())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op4_weak_label_quality")
def op4_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer, _ = weak_labels.train(docs)
    return weak_labels.score(docs, scorer).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS u FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.u, c.u) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op11_threshold_top_k", TOPK_SQL)
def op11_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=50, k=5)


PHRASE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM u, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(ws)),
c AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
x AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS ws FROM c WHERE k > 1 AND f >= 10),
s AS (SELECT lang, array_to_string(list_slice(ws, i, i + 1), ' ') AS g, max(a) AS most FROM x, (VALUES (1), (2)) v(i) WHERE k = 3 GROUP BY ALL),
y AS (SELECT x.*, array_to_string(list_slice(ws, 1, j), ' ') AS lg, array_to_string(list_slice(ws, j + 1, k), ' ') AS rg, j
      FROM x LEFT JOIN s USING (lang, g), (VALUES (1), (2)) v(j) WHERE j < k AND (k = 3 OR most IS NULL OR 100 * most < 50 * a)),
z AS (SELECT y.lang, y.g AS phrase, a, cl.f AS l, cr.f AS r, CAST((1000000::HUGEINT * a * a) // (cl.f::HUGEINT * cr.f) AS BIGINT) AS score, j
      FROM y JOIN c cl ON cl.lang = y.lang AND cl.g = lg JOIN c cr ON cr.lang = y.lang AND cr.g = rg),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", PHRASE_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


RANKED_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT doc_id, len(ws) AS n, ws FROM t WHERE len(ws) > 0),
s AS (SELECT count(*) AS nd, sum(n) AS nl FROM d),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS w FROM benchmark),
o AS (SELECT doc_id, n, unnest(ws) AS w FROM d),
f AS (SELECT doc_id, n, w, count(*) AS tf FROM o WHERE w IN (SELECT w FROM q) GROUP BY ALL),
g AS (SELECT w, CAST(floor(1000 * ln((2 * max(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, s GROUP BY w),
p AS (SELECT doc_id, f.w, CAST(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nl))) AS BIGINT) AS impact FROM f JOIN g ON f.w = g.w, s),
r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN p ON q.w = p.w GROUP BY item_id, doc_id HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


@query("op13_dual_tree_search", RANKED_SQL)
def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
