"""Queries on text-pair metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagescale.operators import metrics as O
from pagescale.plans import fixtures as fx
from pagescale.plans.catalog import query, rounded
from pagescale.plans.oracles import folded
from pagescale.session import spread

TOKENS = "SELECT id, len(ref) AS n_ref, len(hyp) AS n_hyp FROM ocr_tokens"
SETS = """SELECT id, lang, CASE WHEN len(hyp)=0 THEN NULL ELSE len(list_intersect(list_distinct(ref), list_distinct(hyp)))/len(list_distinct(hyp))::DOUBLE END AS precision,
  CASE WHEN len(ref)=0 THEN NULL ELSE len(list_intersect(list_distinct(ref), list_distinct(hyp)))/len(list_distinct(ref))::DOUBLE END AS recall FROM ocr_tokens"""
SCORED = f"SELECT *, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision=0 OR recall=0 THEN 0 ELSE 1/(0.5/precision+0.5/recall) END AS f_measure FROM ({SETS})"
EDIT = f"SELECT id, lang, CASE WHEN greatest(length(prediction), length(ground_truth))=0 THEN 0 ELSE levenshtein({folded('prediction')}, {folded('ground_truth')})/greatest(length(prediction), length(ground_truth))::DOUBLE END AS edit_dist FROM ocr_blocks"
GRAMS = " UNION ALL ".join(
    f"SELECT id, {n} AS n, side, list_slice(toks, i, i+{n - 1}) AS g FROM (SELECT id, side, toks, unnest(range(1, len(toks)+{2 - n})) AS i FROM sides WHERE len(toks) >= {n})" for n in range(1, 5)
)
BLEU = f"""sides AS (SELECT id, 'r' AS side, ref AS toks FROM ocr_tokens UNION ALL SELECT id, 'h', hyp FROM ocr_tokens),
grams AS ({GRAMS}), cnt AS (SELECT id, n, g, count(*) FILTER (WHERE side='r') AS r, count(*) FILTER (WHERE side='h') AS h FROM grams GROUP BY ALL),
m AS (SELECT id, n, sum(least(r, h)) AS m FROM cnt GROUP BY ALL),
p AS (SELECT t.id, t.n_ref, t.n_hyp, ln(greatest(coalesce(m.m, 0)/greatest(t.n_hyp-k.n+1, 1)::DOUBLE, 1e-300::DOUBLE)) AS lp, k.n, coalesce(m.m, 0) AS mm FROM ({TOKENS}) t CROSS JOIN (VALUES (1),(2),(3),(4)) k(n) LEFT JOIN m ON m.id=t.id AND m.n=k.n),
bleu AS (SELECT id, CASE WHEN any_value(n_hyp)=0 OR sum(CASE WHEN n=1 THEN mm ELSE 0 END)=0 THEN 0 ELSE CASE WHEN any_value(n_hyp) > any_value(n_ref) THEN 1 ELSE exp(1-any_value(n_ref)/any_value(n_hyp)::DOUBLE) END*exp(avg(lp)) END AS bleu FROM p GROUP BY id)"""


@query("met1_tokenize", TOKENS.replace("SELECT id,", "SELECT id, array_to_string(hyp, '|') AS hyp,"))
def tokens(spark, d):
    t = O.tokenize(fx.ocr_blocks(spark, d))
    return t.select("id", F.array_join("hyp", "|").alias("hyp"), F.size("ref").alias("n_ref"), F.size("hyp").alias("n_hyp"))


@query("met2_bleu4", f"WITH {BLEU} SELECT id, round(bleu+1e-9, 6) AS bleu FROM bleu")
def bleu(spark, d):
    return rounded(O.bleu4(O.tokenize(fx.ocr_blocks(spark, d))))


@query("met3_set_precision_recall", f"SELECT id, round(precision+1e-9, 6) AS precision, round(recall+1e-9, 6) AS recall FROM ({SETS})")
def sets(spark, d):
    return rounded(O.set_scores(O.tokenize(fx.ocr_blocks(spark, d))).select("id", "precision", "recall"))


@query("met4_f_measure", f"SELECT id, round(f_measure+1e-9, 6) AS f_measure FROM ({SCORED})")
def f_measure(spark, d):
    return rounded(O.set_scores(O.tokenize(fx.ocr_blocks(spark, d))).select("id", "f_measure"))


@query("met5_edit_dist", f"SELECT id, round(edit_dist+1e-9, 6) AS edit_dist FROM ({EDIT})")
def edit(spark, d):
    return rounded(O.with_edit_dist(spread(fx.ocr_blocks(spark, d), "id")).select("id", "edit_dist"))


@query(
    "met6_meteor_exact",
    """WITH s AS (SELECT id, 'r' AS side, unnest(ref) AS t, generate_subscripts(ref, 1) AS pos FROM ocr_tokens UNION ALL SELECT id, 'h', unnest(hyp), generate_subscripts(hyp, 1) FROM ocr_tokens),
    k AS (SELECT id, side, lower(t) AS t, pos, row_number() OVER (PARTITION BY id, side, lower(t) ORDER BY pos DESC) AS k FROM s),
    j AS (SELECT h.id, h.pos AS hp, r.pos AS rp FROM k h JOIN k r ON h.id=r.id AND h.t=r.t AND h.k=r.k AND h.side='h' AND r.side='r'),
    c AS (SELECT id, CASE WHEN lag(hp) OVER w + 1 = hp AND lag(rp) OVER w + 1 = rp THEN 0 ELSE 1 END AS head FROM j WINDOW w AS (PARTITION BY id ORDER BY hp)),
    a AS (SELECT id, count(*) AS m, sum(head) AS ch FROM c GROUP BY id)
    SELECT t.id, round(CASE WHEN m IS NULL THEN 0 ELSE (1-0.5*power(ch/m::DOUBLE, 3))*(m/len(hyp)::DOUBLE)*(m/len(ref)::DOUBLE)/(0.9*m/len(hyp)::DOUBLE+0.1*m/len(ref)::DOUBLE) END+1e-9, 6) AS meteor FROM ocr_tokens t LEFT JOIN a USING (id)""",
)
def meteor(spark, d):
    return rounded(O.meteor_exact(O.tokenize(fx.ocr_blocks(spark, d))))


@query(
    "met7_score_pairs",
    f"""WITH {BLEU}, e AS ({EDIT}), f AS ({SCORED}) SELECT b.id, round(bleu+1e-9, 6) AS bleu, round(f_measure+1e-9, 6) AS f_measure, round(precision+1e-9, 6) AS precision, round(recall+1e-9, 6) AS recall, round(edit_dist+1e-9, 6) AS edit_dist,
    CAST(length(ground_truth) AS INT) AS text_token_len, CAST(length(ground_truth) AS INT) AS text_len FROM bleu b JOIN e USING (id) JOIN f USING (id) JOIN ocr_blocks o USING (id)""",
)
def score(spark, d):
    return rounded(O.score_pairs(fx.ocr_blocks(spark, d)))


@query(
    "met8_mean_scores",
    f"""WITH e AS ({EDIT}), f AS ({SCORED}) SELECT count(*) AS n, round(avg(f_measure)+1e-9, 6) AS f_measure, round(avg(precision)+1e-9, 6) AS precision, round(avg(recall)+1e-9, 6) AS recall, round(avg(edit_dist)+1e-9, 6) AS edit_dist FROM e JOIN f USING (id)""",
)
def mean_scores(spark, d):
    return rounded(O.mean_metrics(O.score_pairs(fx.ocr_blocks(spark, d), with_bleu=False)))


SWAPPED = "swapped AS (SELECT id, lang, hyp AS ref, ref AS hyp FROM ocr_tokens)"


def _on_swapped(sql: str) -> str:
    return sql.replace("ocr_tokens", "swapped")


@query(
    "agg1_mean_metrics",
    f"""WITH {SWAPPED}, {_on_swapped(BLEU)}, e AS ({EDIT}), f AS ({_on_swapped(SCORED)}) SELECT count(*) AS n, round(avg(bleu)+1e-9, 6) AS bleu, round(avg(f_measure)+1e-9, 6) AS f_measure,
    round(avg(precision)+1e-9, 6) AS precision, round(avg(recall)+1e-9, 6) AS recall, round(avg(edit_dist)+1e-9, 6) AS edit_dist FROM e JOIN f USING (id) JOIN bleu USING (id)""",
)
def swapped_means(spark, d):
    return rounded(O.mean_metrics(O.score_pairs(fx.ocr_blocks(spark, d), swap_roles=True)))


@query(
    "flow_scores_by_language",
    f"""WITH e AS ({EDIT}), f AS ({SCORED}) SELECT lang, count(*) AS n, round(avg(f_measure)+1e-9, 6) AS f_measure, round(avg(precision)+1e-9, 6) AS precision, round(avg(recall)+1e-9, 6) AS recall, round(avg(edit_dist)+1e-9, 6) AS edit_dist
    FROM e JOIN f USING (id, lang) GROUP BY lang""",
)
def flow(spark, d):
    """Blocks of all documents, their recognised text, all row-local scores, mean per language."""
    rows = O.with_edit_dist(O.set_scores(O.tokenize(spread(fx.ocr_blocks(spark, d), "id"))))
    return rounded(O.mean_metrics(rows, ["lang"]))
