"""Text-pair metrics. Pairs move once, by id; all grams and tokens of a pair are counted where the pair is."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale.functions import text as X
from pagescale.schema import assert_columns
from pagescale.session import cut_lineage, spread

TINY = 1e-300


def tokenize(df: DataFrame) -> DataFrame:
    """Adds ``ref`` and ``hyp`` token arrays; one side with ideographs switches both sides."""
    assert_columns(df, ["id", "prediction", "ground_truth"])
    cjk = X.has_cjk(F.col("prediction")) | X.has_cjk(F.col("ground_truth"))
    return df.select("*", X.tokens(F.col("ground_truth"), cjk).alias("ref"), X.tokens(F.col("prediction"), cjk).alias("hyp"))


def orient(df: DataFrame, swap_roles: bool) -> DataFrame:
    """``swap_roles`` scores with prediction and ground truth exchanged, as the published numbers were made."""
    if not swap_roles:
        return df
    return df.withColumns({"prediction": F.col("ground_truth"), "ground_truth": F.col("prediction")})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _clipped_matches(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """For runs of 1 to 4 tokens: how many of ``hyp`` are found in ``ref``, each run at most as often as it stands there."""

    def matches(r: list, h: list, n: int) -> int:
        left = Counter(zip(*[r[i:] for i in range(n)]))
        return sum(min(c, left[g]) for g, c in Counter(zip(*[h[i:] for i in range(n)])).items() if g in left)

    return pd.Series([[matches(r, h, n) for n in range(1, 5)] for r, h in zip(map(list, ref), map(list, hyp))])


def _bleu_score(m: Sequence[Column], n_ref: Column, n_hyp: Column) -> Column:
    log_p = sum(F.ln(F.greatest(c / F.greatest(n_hyp - k, F.lit(1)), F.lit(TINY))) for k, c in enumerate(m))
    brevity = F.when(n_hyp > n_ref, F.lit(1.0)).otherwise(F.exp(1 - n_ref / n_hyp))
    return F.when((n_hyp == 0) | (m[0] == 0), F.lit(0.0)).otherwise(brevity * F.exp(log_p / 4))


def with_bleu4(tokenized: DataFrame) -> DataFrame:
    """Adds ``bleu`` of every row by itself. Row-local."""
    m = [F.get("_m", F.lit(k)) for k in range(4)]
    return tokenized.withColumn("_m", _clipped_matches("ref", "hyp")).withColumn("bleu", _bleu_score(m, F.size("ref"), F.size("hyp"))).drop("_m")


def _by_id(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id stands once, rows of ids that repeat or None). Only ids are counted and moved."""
    again = cut_lineage(rows.groupBy(F.col("id").alias("_again")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("_again"), "again")
    if again.isEmpty():
        return rows, None
    met = F.col("id").eqNullSafe(F.col("_again"))
    return rows.join(again, met, "left_anti"), rows.join(again, met, "left_semi")


def bleu4(tokenized: DataFrame) -> DataFrame:
    """Sentence BLEU with one reference, uniform weights 1-4 and brevity penalty, per id.

    No unigram match gives 0; a higher order without a match contributes the smallest positive number. A row whose id
    stands once is scored where it is; the grams of rows with one id are counted together.
    """
    once, more = _by_id(tokenized.select("id", "ref", "hyp"))
    out = with_bleu4(once).select("id", "bleu")
    return out if more is None else out.unionByName(_pooled_bleu(more))


def _pooled_bleu(rows: DataFrame) -> DataFrame:
    """BLEU from the grams of all rows of an id and of equal lengths."""
    # Grams are cut from the arrays; tokens hold no white space, so a joined gram stands for its tokens.
    def side(col: str, flag: int) -> list[Column]:
        runs = lambda n: F.slice(col, F.lit(1), F.greatest(F.size(col) - (n - 1), F.lit(0)))
        gram = lambda n, i: F.array_join(F.slice(col, i + 1, F.lit(n)), " ")
        cut = lambda n: lambda t, i: F.struct(F.lit(flag).alias("is_ref"), F.lit(n).alias("n"), (t if n == 1 else gram(n, i)).alias("g"))
        return [F.transform(runs(n), cut(n)) for n in range(1, 5)]

    grams = spread(rows, "id").select(
        "id", F.size("ref").alias("n_ref"), F.size("hyp").alias("n_hyp"), F.explode_outer(F.concat(*side("ref", 1), *side("hyp", 0))).alias("e")
    ).select("id", "n_ref", "n_hyp", "e.*")  # a pair without tokens keeps its id
    counted = grams.groupBy("id", "n_ref", "n_hyp", "n", "g").agg(
        F.count_if(F.col("is_ref") == 1).alias("r"), F.count_if(F.col("is_ref") == 0).alias("h")
    )
    clipped = [F.sum(F.when(F.col("n") == k, F.least("r", "h")).otherwise(0)).alias(f"m{k}") for k in range(1, 5)]
    per_id = counted.groupBy("id", "n_ref", "n_hyp").agg(*clipped)
    return per_id.select("id", _bleu_score([F.col(f"m{k}") for k in range(1, 5)], F.col("n_ref"), F.col("n_hyp")).alias("bleu"))


def set_scores(tokenized: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Precision, recall and F on token sets; NULL where a side has no token. Row-local."""
    common = F.size(F.array_intersect("ref", "hyp"))
    p = F.try_divide(common, F.size(F.array_distinct("hyp")))
    r = F.try_divide(common, F.size(F.array_distinct("ref")))
    f = F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when((p == 0) | (r == 0), F.lit(0.0)).otherwise(
        1.0 / (alpha / F.col("precision") + (1 - alpha) / F.col("recall"))
    )
    return tokenized.select("*", p.alias("precision"), r.alias("recall")).withColumn("f_measure", f)


def meteor_exact(tokenized: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """METEOR with the exact-match stage on lower-cased tokens, per id. Equal tokens pair up from the end of both texts."""
    placed = spread(tokenized.select("id", "ref", "hyp"), "id")
    side = lambda col, name: F.transform(
        col, lambda t, i: F.struct(F.lit(name).alias("side"), i.alias("pos"), F.lower(t).alias("tok"))
    )
    toks = placed.select(
        "id", F.size("ref").alias("n_ref"), F.size("hyp").alias("n_hyp"),
        F.explode_outer(F.concat(side(F.col("ref"), "r"), side(F.col("hyp"), "h"))).alias("e"),
    ).select("id", "n_ref", "n_hyp", "e.*")
    from_end = F.row_number().over(W.partitionBy("id", "side", "tok").orderBy(F.desc("pos")))
    pairs = toks.withColumn("k", from_end).groupBy("id", "n_ref", "n_hyp", "tok", "k").agg(
        F.max(F.when(F.col("side") == "r", F.col("pos"))).alias("rp"), F.max(F.when(F.col("side") == "h", F.col("pos"))).alias("hp")
    )
    hit = F.col("rp").isNotNull() & F.col("hp").isNotNull()
    order = W.partitionBy("id").orderBy(F.when(hit, F.col("hp")).asc_nulls_last())
    follows = (F.lag("hp").over(order) + 1 == F.col("hp")) & (F.lag("rp").over(order) + 1 == F.col("rp"))
    per_id = pairs.withColumn("hit", hit).withColumn("head", F.col("hit") & ~F.coalesce(follows, F.lit(False))).groupBy(
        "id", "n_ref", "n_hyp"
    ).agg(F.count_if("hit").alias("m"), F.count_if("head").alias("chunks"))
    p, r = F.col("m") / F.col("n_hyp"), F.col("m") / F.col("n_ref")
    mean = p * r / (alpha * p + (1 - alpha) * r)
    score = (1 - gamma * F.pow(F.col("chunks") / F.col("m"), F.lit(beta))) * mean
    return per_id.select("id", F.when(F.col("m") == 0, F.lit(0.0)).otherwise(score).alias("meteor"))


def with_edit_dist(df: DataFrame) -> DataFrame:
    return df.withColumn("edit_dist", X.edit_distance(F.col("prediction"), F.col("ground_truth")))


def score_pairs(pairs: DataFrame, swap_roles: bool = False, with_bleu: bool = True) -> DataFrame:
    """One row per id with all scores, token length (characters when missing) and text length."""
    base = tokenize(orient(spread(pairs, "id"), swap_roles))
    if "text_token_len" not in base.columns:
        base = base.withColumn("text_token_len", F.lit(None).cast("int"))
    if "text_len" not in base.columns:
        base = base.withColumn("text_len", F.length("ground_truth"))
    chars = F.length("ground_truth")
    rows = lambda df, *more: with_edit_dist(set_scores(df)).select(
        "id", *more, "f_measure", "precision", "recall", "edit_dist",
        F.coalesce("text_token_len", chars).alias("text_token_len"), F.coalesce("text_len", chars).alias("text_len"),
    )
    if not with_bleu:
        return rows(base)
    once, more = _by_id(base.where(F.col("id").isNotNull()))
    scored = rows(with_bleu4(once), "bleu")
    if more is None:
        return scored
    return scored.unionByName(rows(more).join(_pooled_bleu(more), "id").select(scored.columns))


def mean_metrics(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and the mean of every numeric metric."""
    names = [c for c in ("bleu", "meteor", "f_measure", "precision", "recall", "edit_dist") if c in scores.columns]
    return scores.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])
