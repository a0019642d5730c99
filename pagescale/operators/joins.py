"""Alignment of images, ground truth, predictions, sizes and fitted intervals.

No join carries a broadcast hint on data that grows: sizes are left to the adaptive planner, which also splits skewed
partitions. Duplicate keys are reduced by combinable aggregates before they meet a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import geometry as G
from pagescale.functions import text as X
from pagescale.operators.filters import keep_blocks
from pagescale.session import cut_lineage, discard, meet

CANVAS_BLOCK = 64
MOST_BLOCKS = 4096


def _one_per_key(df: DataFrame, key: str, pos: Column | None = None, first: bool = False) -> DataFrame:
    """One row per key, as a table of unique keys holds it: the last by ``pos`` (or the first).

    ``pos`` defaults to the column of that name. Without any position, and among rows of equal position, the greatest
    (smallest) values count, so that reruns agree.
    """
    values = [c for c in df.columns if c not in (key, "pos")]
    if pos is None and "pos" in df.columns:
        pos = F.col("pos")
    order = F.struct(*([] if pos is None else [pos.alias("pos")]), *values)
    pick = (F.min_by if first else F.max_by)(F.struct(*values), order)
    return df.groupBy(key).agg(pick.alias("_v")).select(key, "_v.*")


def _pos(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "pos"]


def build_eval(images: DataFrame, gt: DataFrame, preds: DataFrame) -> DataFrame:
    """Evaluation records of images that have both a ground truth and a prediction, matched on the file stem.

    Of several ground truths or predictions of one id the last counts (column ``pos`` where present).
    """
    left = images.select(X.file_stem(F.col("image")).alias("id")).distinct()
    truth = _one_per_key(gt.select(X.file_stem(F.col("image")).alias("id"), F.col("gt").alias("label"), "text_token_len", "text_len", *_pos(gt)), "id")
    answer = _one_per_key(preds.select("id", "markdown", *_pos(preds)), "id").select("id", X.md_to_text(F.col("markdown")).alias("answer"))
    return left.join(truth, "id").join(answer, "id").select("id", "label", "answer", "text_token_len", "text_len")


def missing_report(images: DataFrame, gt: DataFrame, preds: DataFrame) -> DataFrame:
    """Image ids without ground truth, and ids with ground truth but without prediction."""
    left = images.select(X.file_stem(F.col("image")).alias("id")).distinct()
    truth = gt.select(X.file_stem(F.col("image")).alias("id"))
    no_gt = left.join(truth, "id", "left_anti").withColumn("missing", F.lit("ground_truth"))
    no_pred = left.join(truth, "id", "left_semi").join(preds.select("id"), "id", "left_anti")
    return no_gt.unionByName(no_pred.withColumn("missing", F.lit("prediction")))


def _exact_or_base(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Value under the exact id, else under the id without its shift suffix: two equi joins."""
    exact = right.select("id", F.col(value).alias("_exact"))
    base = right.select(F.col("id").alias("base_id"), F.col(value).alias("_base"))
    joined = left.join(exact, "id", "left").join(base, "base_id", "left")
    return joined.withColumn(value, F.coalesce("_exact", "_base")).drop("_exact", "_base")


def build_eval_shifted(images: DataFrame, gt: DataFrame, preds: DataFrame) -> DataFrame:
    """Evaluation records of shifted images; ids fall back to the unshifted name. The last record of an id counts."""
    left = images.select(X.file_stem(F.col("image")).alias("id")).withColumn("base_id", X.strip_shift_suffix(F.col("id")))
    truth = _one_per_key(gt.select(
        X.file_stem(F.col("image")).alias("id"), F.struct(F.col("gt").alias("label"), "text_token_len", "text_len").alias("t"), *_pos(gt)
    ), "id")
    answer = _one_per_key(preds.select("id", "markdown", *_pos(preds)), "id").select("id", X.md_to_text(F.col("markdown")).alias("answer"))
    both = _exact_or_base(_exact_or_base(left, truth, "t"), answer, "answer")
    return both.where(F.col("t").isNotNull() & F.col("answer").isNotNull()).select(
        "id", "t.label", "answer", "t.text_token_len", "t.text_len"
    )


def enrich_text_len(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target rows with the source's text length; the last source row of an image wins, old values stay when missing."""
    latest = source.groupBy(X.file_stem(F.col("image")).alias("id")).agg(F.max_by("text_len", "pos").alias("_new"))
    joined = target.join(latest, "id", "left")
    return joined.withColumn("updated", F.col("_new").isNotNull()).withColumn(
        "text_len", F.coalesce("_new", "text_len")
    ).drop("_new")


def enrich_counts(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count_if("updated").alias("n_updated"), F.count_if(~F.col("updated")).alias("n_missing"))


def alias_any(df: DataFrame, *names: str) -> Column:
    """First of the given columns that the table has; all present ones are coalesced in order."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        raise ValueError(f"none of the columns {names} is present")
    return F.coalesce(*present)


def construct_features(
    density: DataFrame, meta: DataFrame, images: DataFrame, metrics: DataFrame, style: tuple[int, int, int], resolution: int
) -> DataFrame:
    """Analysis rows: image size, density and lengths are required, the edit distance is optional.

    Each lookup holds one record per image, the last one (column ``pos`` where present). Lengths that the density record
    has itself come before those of the metadata, and its edit distance before that of the metrics.
    """
    font, line, letter = style
    if font not in C.FONT_METRICS:
        raise ValueError(f"unknown font size {font}")
    glyph_w, glyph_h = C.FONT_METRICS[font]
    m = _one_per_key(meta.select(
        X.file_stem(alias_any(meta, "image", "id", "image_id")).alias("image_id"),
        alias_any(meta, "text_token_len", "token_len").alias("token_len"),
        "text_len", *_pos(meta),
    ), "image_id")
    e = _one_per_key(metrics.select(
        alias_any(metrics, "id", "image_id").alias("image_id"), alias_any(metrics, "edit_dist", "edit_distance").alias("edit_distance"), *_pos(metrics)
    ), "image_id")
    types = dict(m.dtypes) | dict(e.dtypes)
    own = lambda *names: alias_any(density, *names) if set(names) & set(density.columns) else F.lit(None)
    d = _one_per_key(density.select(
        alias_any(density, "id", "image_id").alias("image_id"), alias_any(density, "patch_density", "capacity").alias("patch_density"),
        own("text_token_len", "token_len").cast(types["token_len"]).alias("_token_len"), own("text_len").cast(types["text_len"]).alias("_text_len"),
        own("edit_distance", "edit_dist").cast(types["edit_distance"]).alias("_edit_distance"), *_pos(density),
    ), "image_id")
    i = images.select(X.file_stem(F.col("image")).alias("image_id"), F.col("width").alias("image_W"), F.col("height").alias("image_H"))
    first_of = lambda name: F.coalesce(f"_{name}", name).alias(name)
    rows = i.join(d, "image_id").join(m, "image_id", "left").join(e, "image_id", "left").select(
        *i.columns, "patch_density", first_of("token_len"), first_of("text_len"), first_of("edit_distance")
    )
    return (
        rows.where(F.col("patch_density").isNotNull() & F.col("token_len").isNotNull() & F.col("text_len").isNotNull())
        .select(
            "image_id", "patch_density",
            F.lit(font).alias("font_size"), F.lit(line).alias("line_spacing"), F.lit(letter).alias("letter_spacing"),
            "token_len", "text_len", F.lit(resolution).alias("resolution"), "image_W", "image_H",
            F.lit(glyph_w).alias("character_width"), F.lit(glyph_h).alias("character_height"),
            (F.lit(glyph_w) * resolution / F.col("image_W")).alias("model_W"),
            (F.lit(glyph_h) * resolution / F.col("image_H")).alias("model_H"),
            "edit_distance",
        )
    )


def density_with_metrics(images: DataFrame, meta: DataFrame, metrics: DataFrame, char_w: float, char_h: float, resolution: int) -> DataFrame:
    """Patch density and lengths per image, with the edit distance where it was scored; the first metadata record counts."""
    i = images.select(X.file_stem(F.col("image")).alias("id"), "width", "height")
    m = _one_per_key(meta.select(X.file_stem(F.col("image")).alias("id"), "text_token_len", "text_len", *_pos(meta)), "id", first=True)
    e = _one_per_key(metrics.select("id", "edit_dist", *_pos(metrics)), "id")
    density = G.patch_density(F.col("width"), F.col("height"), F.lit(char_w), F.lit(char_h), F.lit(resolution))
    return i.join(m, "id").join(e, "id", "left").select(
        "id", density.alias("patch_density"), "text_token_len", "text_len", "edit_dist"
    )


def font_lookup(df: DataFrame) -> DataFrame:
    """Glyph width and height of the font; NULL for an unknown size. The table has three fixed entries."""
    return df.withColumn("character_width", G.font_width(F.col("font_size"))).withColumn(
        "character_height", G.font_height(F.col("font_size"))
    )


def selected_with_gt(ids: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids with their first ground truth, ids without any)."""
    first = gt.groupBy(X.file_stem(F.col("image")).alias("id")).agg(F.min_by("gt", "pos").alias("gt"))
    wanted = ids.select("id").distinct()
    return wanted.join(first, "id"), wanted.join(first, "id", "left_anti")


def canvas_fit(images: DataFrame, canvases: DataFrame) -> DataFrame:
    """Every canvas an image fits on, with its area.

    A dominance join on a block skyline. Canvases are range-sorted by width and height into blocks of about CANVAS_BLOCK
    that carry their greatest width and height, at most MOST_BLOCKS of them; an image meets only the blocks whose corner
    holds it. A block is met by the number of its canvases, not by a class that all images might share, and no row of
    the result is sorted. Sizes that are NULL or not positive fit nothing.
    """
    usable = canvases.where((F.col("canvas_w") > 0) & (F.col("canvas_h") > 0)).select("canvas_w", "canvas_h").distinct()
    usable = cut_lineage(usable, "canvases")
    n_blocks = max(1, min(MOST_BLOCKS, -(-usable.count() // CANVAS_BLOCK)))
    blocks = usable.repartitionByRange(n_blocks, "canvas_w", "canvas_h").withColumn("_block", F.spark_partition_id())
    blocks = cut_lineage(blocks, "canvas-blocks")
    discard(usable)
    corner = blocks.groupBy("_block").agg(F.max("canvas_w").alias("w"), F.max("canvas_h").alias("h"))
    skyline = cut_lineage(corner.agg(F.collect_list(F.struct("_block", "w", "h")).alias("_skyline")), "skyline")  # one row of at most MOST_BLOCKS corners
    holds = F.filter("_skyline", lambda c: (c["w"] >= F.col("width")) & (c["h"] >= F.col("height")))
    visits = images.where((F.col("width") > 0) & (F.col("height") > 0)).join(F.broadcast(skyline))
    visits = visits.withColumn("_block", F.explode(F.transform(holds, lambda c: c["_block"]))).drop("_skyline")
    fits = visits.join(blocks, "_block").where((F.col("canvas_w") >= F.col("width")) & (F.col("canvas_h") >= F.col("height")))
    return fits.drop("_block").withColumn("area", F.col("canvas_w").cast("long") * F.col("canvas_h"))


def fits_fixed_canvas(images: DataFrame, side: int = 3584) -> DataFrame:
    """Fit flag and the centred paste offset (NULL for images that are skipped)."""
    fits = (F.col("width") <= side) & (F.col("height") <= side)
    offset = lambda c: F.when(fits, F.floor((side - F.col(c)) / 2).cast("int"))
    return images.select("id", "width", "height", fits.alias("fits"), offset("width").alias("x"), offset("height").alias("y"))


def largest_size(images: DataFrame) -> DataFrame:
    return images.agg(F.max("width").alias("max_w"), F.max("height").alias("max_h"))


def pages_with_distance(edit: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edit rows with their page, ordered by base name and suffix; names without a page)."""
    keyed = pages.where(F.col("page_info.image_path").isNotNull()).select(
        F.col("page_info.image_path").alias("name"), "page_info.page_no", "page_info.width", "page_info.height"
    )
    stem = X.file_stem(F.col("name"))
    found = edit.join(keyed, "name").withColumn("base", X.suffix_base(stem)).withColumn("suffix", X.suffix_number(stem))
    return found.sort("base", "suffix", "name"), edit.join(keyed, "name", "left_anti")


def merge_truncated(pages: DataFrame, last_pair_only: bool = False) -> DataFrame:
    """Layout pages whose blocks marked as truncated parts of each other are merged.

    The pair list of a page is folded in order: both ends must exist and neither may have been merged away before. The
    first block in layout order represents the pair. Its box becomes the union, texts join by line breaks in reading
    order. ``last_pair_only`` keeps only the last tail of a representative, as the published data set does.
    """
    keep = [c for c in pages.columns if c not in ("layout_dets", "relations")]
    ids = F.transform(F.col("layout_dets"), lambda b: b["anno_id"])
    wanted = F.filter(
        F.coalesce("relations", F.array().cast("array<struct<relation_type:string,source_anno_id:int,target_anno_id:int>>")),
        lambda r: (r["relation_type"] == "truncated")
        & (r["source_anno_id"] != r["target_anno_id"])
        & F.array_contains(ids, r["source_anno_id"])
        & F.array_contains(ids, r["target_anno_id"]),
    )
    located = F.transform(
        wanted,
        lambda r: F.struct(
            F.least(F.array_position(ids, r["source_anno_id"]), F.array_position(ids, r["target_anno_id"])).cast("int").alias("head"),
            F.greatest(F.array_position(ids, r["source_anno_id"]), F.array_position(ids, r["target_anno_id"])).cast("int").alias("tail"),
        ),
    )
    start = F.array().cast("array<struct<head:int,tail:int>>")
    gone = lambda done, pos: F.exists(done, lambda d: d["tail"] == pos)
    pairs = F.aggregate(
        F.array_distinct(located),
        start,
        lambda done, p: F.when(gone(done, p["head"]) | gone(done, p["tail"]), done).otherwise(F.concat(done, F.array(p))),
    )

    def merged(layout: Column, done: Column) -> Column:
        def block(b: Column, i: Column) -> Column:
            tails = F.filter(done, lambda d: d["head"] == i + 1)
            used = F.slice(tails, -1, 1) if last_pair_only else tails
            members = F.concat(F.array(F.struct((i + 1).alias("head"), (i + 1).alias("tail"))), used)
            parts = F.array_sort(
                F.transform(
                    members,
                    lambda m: F.struct(
                        F.coalesce(F.get(layout, m["tail"] - 1)["order"], F.lit(2**31 - 1)).alias("o"),
                        m["tail"].alias("pos"),
                        F.get(layout, m["tail"] - 1).alias("b"),
                    ),
                )
            )
            return F.when(F.size(tails) == 0, b).otherwise(X.let(parts, lambda ps: _union_block(ps)))

        whole = F.transform(layout, lambda b, i: F.struct(i.alias("i"), block(b, i).alias("b")))
        return F.transform(F.filter(whole, lambda w: ~gone(done, w["i"] + 1)), lambda w: w["b"])

    layout = X.let(F.col("layout_dets"), lambda lay: X.let(pairs, lambda done: merged(lay, done)))
    return pages.select(*keep, layout.alias("layout_dets"))


def _union_block(parts: Column) -> Column:
    """One block from parts ``struct<o, pos, b>`` in reading order."""
    first = F.element_at(parts, 1)["b"]
    polys = F.filter(F.transform(parts, lambda p: p["b"]["poly"]), lambda q: q.isNotNull() & (F.size(q) > 0))
    xs = F.flatten(F.transform(polys, lambda q: F.filter(q, lambda v, i: i % 2 == 0)))
    ys = F.flatten(F.transform(polys, lambda q: F.filter(q, lambda v, i: i % 2 == 1)))
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    texts = F.filter(F.transform(parts, lambda p: p["b"]["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.struct(
        first["anno_id"].alias("anno_id"),
        first["category_type"].alias("category_type"),
        first["order"].alias("order"),
        first["ignore"].alias("ignore"),
        F.when(F.size(xs) > 0, F.array(x0, y0, x1, y0, x1, y1, x0, y1)).otherwise(first["poly"]).alias("poly"),
        F.when(F.size(texts) > 0, F.array_join(texts, "\n")).otherwise(first["text"]).alias("text"),
    )


def reading_order(pages: DataFrame) -> DataFrame:
    """Pages with only their allowed blocks in reading order."""
    return pages.withColumn("layout_dets", keep_blocks(F.col("layout_dets")))


def best_per_key(df: DataFrame) -> DataFrame:
    """Row of least edit distance per unshifted id (ties: the smaller id)."""
    best = F.min(F.struct("edit_dist", "id", "text_len")).alias("_b")
    return df.groupBy(X.strip_shift_suffix(F.col("id")).alias("base_id")).agg(best, F.count("*").alias("n_shifts")).select(
        "base_id", F.col("_b.id").alias("best_id"), F.col("_b.edit_dist").alias("edit_dist"),
        F.col("_b.text_len").alias("text_len"), "n_shifts",
    )


def pair_before_after(base: DataFrame, shifted: DataFrame) -> DataFrame:
    """Baseline points, flagged when the id was selected for shifting, with the best shifted distance."""
    ok = lambda df: df.where(F.col("edit_dist").isNotNull() & F.col("text_len").isNotNull() & F.col("id").isNotNull())
    best = best_per_key(ok(shifted)).select("base_id", F.col("edit_dist").alias("best_edit_dist"))
    points = ok(base).withColumn("base_id", X.strip_shift_suffix(F.col("id")))
    return points.join(best, "base_id", "left").select(
        "base_id", "text_len", "edit_dist", F.col("best_edit_dist").isNotNull().alias("selected"), "best_edit_dist"
    )


def points_with_sizes(metrics: DataFrame, sizes: DataFrame) -> DataFrame:
    """Points with the scale of the longer side against 1024; 0 when the size is unknown. The last size of an id counts."""
    scale = F.coalesce(F.greatest("width", "height") / 1024.0, F.lit(0.0))
    return metrics.join(_one_per_key(sizes.select("id", "width", "height", *_pos(sizes)), "id"), "id", "left").select("id", "text_len", "edit_dist", scale.alias("scale"))


def near_boundary_mean(points: DataFrame, bounds: DataFrame, column: str, half: float, boundary: str) -> DataFrame:
    """Mean of a column over points whose length lies within ``half`` of their group's boundary.

    A banded join: lengths fall into bands as wide as the range around a boundary, so a boundary is copied to the one or
    two bands that its range touches, and points meet it by group and band. A group's points therefore lie under as many
    keys as its lengths have bands, and those of other bands meet nothing. Boundaries that are not finite have no points.
    """
    finite = bounds.where(F.col(boundary).isNotNull() & ~F.isnan(boundary) & (F.abs(boundary) < float("inf")))
    wide = max(2.0 * half, 1.0)
    band = lambda c: F.floor(c / wide)
    at = finite.select(*C.GROUP_KEYS, F.col(boundary).alias("_at"))
    at = at.withColumn("_band", F.explode(F.sequence(band(F.col("_at") - half), band(F.col("_at") + half))))
    joined = meet(points.withColumn("_band", band(F.col("text_len"))), at, [*C.GROUP_KEYS, "_band"])
    near = joined.where(F.col("text_len").between(F.col("_at") - half, F.col("_at") + half))
    return near.groupBy(*C.GROUP_KEYS).agg(F.avg(column).alias(f"{column}_near"), F.count("*").alias("n_near"))


def with_fitted(points: DataFrame, fits: DataFrame, columns: list[str]) -> DataFrame:
    """Points with fitted values of their group; groups without a fit drop out."""
    return meet(points, fits.select(*C.GROUP_KEYS, *columns), C.GROUP_KEYS)
