"""Seeded sampling and data-set construction. Every draw is a function of ids and seed, so a rerun repeats it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import text as X
from pagescale.functions.text import let
from pagescale.operators.quantiles import SLICE_DIGITS, hash_rank
from pagescale.session import cut_lineage

ROUNDS = 4
LARGEST = 1 << 62


def digest(*cols: Column | str | int) -> Column:
    """Hex digits that order rows by chance, the same in every run and every engine that has MD5."""
    text = lambda c: F.lit(str(c)) if isinstance(c, int) else F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("/", *map(text, cols)))


def chance(*cols: Column | str | int) -> Column:
    """A pseudo-random whole number below 2**60."""
    return F.conv(F.substring(digest(*cols), 1, 15), 16, 10).cast("long")


def unit_hash(*cols: Column | str | int) -> Column:
    """A pseudo-random number in [0, 1): 52 bits, so that it is exact."""
    return F.conv(F.substring(digest(*cols), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample_n(df: DataFrame, n: int, seed: int, ids: list[str]) -> DataFrame:
    """``n`` rows without replacement, all rows if there are fewer, none for ``n <= 0``.

    Rows are taken in one hashed order whatever ``n`` is, so a larger sample holds every smaller one of the same seed.
    """
    if n <= 0:
        return df.limit(0)
    return hash_rank(df, ids, seed, "_rank").where(F.col("_rank") < n).drop("_rank")


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def permuted(i: Column, size: int, *key: Column | int) -> Column:
    """A keyed permutation of the numbers below ``size``.

    The number is written with two digits, a high one of about the root of the size; rounds add to one digit a hash of the
    other, which can be undone. What the two digits do not reach keeps its place. At last all numbers are turned by a key.
    """
    length = len(str(size))
    high = 10 ** ((length + 1) // 2) if length > 1 else 1
    low = size // high
    left, right = div(i, low), i % low
    for r in range(1, ROUNDS + 1):
        if r % 2:
            left = (left + chance(*key, r, right) % high) % high
        else:
            right = (right + chance(*key, r, left) % low) % low
    mixed = F.when(i < high * low, left * low + right).otherwise(i)
    return (mixed + chance(*key, 0) % size) % size


def choose(n: Column, k: Column) -> Column:
    """The number of subsets of k out of n; no step exceeds k times the result."""
    return F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.lit(1).cast("long"), lambda v, i: div(v * (n - k + i), i))


def unranked(number: Column, n: int, k: int) -> Column:
    """The subset of k of the numbers below n that has this number in the combinatorial number system, greatest first.

    The greatest member is the largest c with at most ``number`` subsets of k below it; what is left numbers the rest.
    """
    bits = F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(max(1, n.bit_length())))])

    def add(state: Column, j: Column) -> Column:
        larger = lambda c, b: F.when(c + b < n, F.when(choose(c + b, j) <= state["x"], c + b).otherwise(c)).otherwise(c)
        member = F.aggregate(bits, j - 1, larger)
        return let(member, lambda c: F.struct((state["x"] - choose(c, j)).alias("x"), F.array_append(state["m"], c).alias("m")))

    start = F.struct(number.cast("long").alias("x"), F.array().cast("array<bigint>").alias("m"))
    return F.aggregate(F.sequence(F.lit(k).cast("long"), F.lit(1).cast("long"), F.lit(-1).cast("long")), start, add, lambda s: s["m"])


def classes(total: int, k: int) -> list[tuple[int, int]]:
    """(positions, members) of the residue classes that a group of k takes its members from.

    One class, unless its subsets cannot be numbered in 64 bits; then as few as that takes, with members dealt evenly.
    """
    for s in range(1, max(k, 1) + 1):
        parts = [((total - q + s - 1) // s, (k - q + s - 1) // s) for q in range(s)]
        if all(math.comb(n, m) * max(m, 1) < LARGEST for n, m in parts):
            return parts
    raise ValueError("there are more rows than 64-bit numbers")


def draw_groups(spark: SparkSession, total: int, plan: dict[int, int], seed: int) -> DataFrame:
    """Distinct sorted subsets of the positions below ``total`` as ``(k, group_no, m)``, ``plan[k]`` of each size.

    Draw number g takes the subset whose number is the g-th of a keyed permutation of all subset numbers, so draws differ
    by construction and every count up to the number of subsets is met. Where there are more subsets than 64-bit numbers,
    the positions fall into residue classes and a group has a subset of each: positions stand for rows in hashed order, so
    all groups of rows are still equally likely; the number is then one with a digit for each class.
    """
    out = None
    for k, count in plan.items():
        if k > total:
            raise ValueError("the group size must not exceed the number of rows")
        parts = classes(total, k)
        sizes = [math.comb(n, m) for n, m in parts]
        rest, members, known = F.col("id"), [], []
        for q, ((n, m), size) in enumerate(zip(parts, sizes, strict=True)):
            # later digits are turned by the earlier ones, so that they vary from the first draw on
            digit = rest % size if not known else (rest + chance(seed, k, -1, *known) % size) % size
            rest = div(rest, size)
            known.append(digit)
            if m:
                members.append(F.transform(unranked(permuted(digit, size, seed, k, 100 + q), n, m), lambda c: c * len(parts) + q))  # noqa: B023
        m = F.array_sort(F.concat(*members)) if members else F.array().cast("array<bigint>")
        draws = spark.range(min(count, math.prod(sizes))).select(F.lit(k).alias("k"), F.col("id").alias("group_no"), m.alias("m"))
        out = draws if out is None else out.unionByName(draws)
    return out


def sample_groups(df: DataFrame, ids: list[str], plan: dict[int, int], seed: int) -> DataFrame:
    """Random groups of rows as ``(k, group_no, member_no, ids...)``.

    Draws pick positions in the hashed order of the rows, so the rows are numbered once and joined once for all sizes.
    """
    chosen = draw_groups(df.sparkSession, df.count(), plan, seed)
    numbered = hash_rank(df.select(*ids), ids, seed, "_pos")
    flat = chosen.select("k", "group_no", F.posexplode("m").alias("member_no", "_pos"))
    return flat.join(numbered, "_pos").drop("_pos")


def build_groups(blocks: DataFrame, plan: dict[int, int], seed: int, prefix: str = "group") -> DataFrame:
    """Block groups of every planned size with their joined text; blocks need ``page_id, block_no, text``.

    Only ids are numbered; the texts of the chosen blocks join afterwards.
    """
    keys = ["page_id", "block_no"]
    members = sample_groups(blocks.select(*keys), keys, plan, seed)
    flat = members.join(blocks.select(*keys, "text"), keys)
    code = X.block_code(F.col("page_id"), F.col("block_no"))
    item = F.array_sort(F.collect_list(F.struct("member_no", code.alias("code"), "text")))  # k members
    rows = flat.groupBy("k", "group_no").agg(item.alias("g")).select(
        "k", "group_no", F.transform("g", lambda m: m["code"]).alias("blocks"), F.array_join(F.transform("g", lambda m: m["text"]), " ").alias("gt")
    )
    return rows.withColumn("image", F.concat_ws("_", F.lit(prefix), F.col("k").cast("string"), F.array_join("blocks", "")))


def pick_per_record(df: DataFrame, sizes: list[int], seed: int, blocks: str = "blocks", key: str = "page_id") -> DataFrame:
    """Per page and size: that many blocks in hashed order, joined by a blank line; skipped when one is blank or missing."""
    tagged = F.transform(F.col(blocks), lambda b, i: F.struct(digest(seed, key, "size", i).alias("h"), i.alias("i"), X.strip(b).alias("t")))
    sized = df.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.size(blocks) >= F.col("size"))
    picked = sized.withColumn("_p", F.slice(F.array_sort(tagged), F.lit(1), F.col("size"))).where(~F.exists("_p", lambda p: p["t"] == ""))
    return picked.select(
        key, "size", F.transform("_p", lambda p: p["i"] + 1).alias("block_nos"),
        F.array_join(F.transform("_p", lambda p: p["t"]), "\n\n").alias("gt"),
    )


def cross_widths(df: DataFrame, widths: list[int], padding: int = 20) -> DataFrame:
    """One row per distinct positive width with its wrap width in characters."""
    usable = sorted({w for w in widths if w > 0})
    wrap = F.greatest(F.floor(F.greatest(F.col("width") - 2 * padding, F.lit(50)) / 8).cast("int"), F.lit(10))
    return df.select("*", F.explode(F.array(*map(F.lit, usable))).alias("width")).withColumn("wrap_width", wrap)


def cross_styles(df: DataFrame, fonts=C.FONT_SIZES, line_list=C.LINE_SPACINGS, letters=C.LETTER_SPACINGS) -> DataFrame:
    """Every style of the grid for every row."""
    styles = F.array(
        *[
            F.struct(F.lit(f).alias("font_size"), F.lit(s).alias("line_spacing"), F.lit(c).alias("letter_spacing"))
            for f in fonts for s in line_list for c in letters
        ]
    )
    return df.select("*", F.inline(styles))


def cross_density_groups(df: DataFrame) -> DataFrame:
    presets = F.array(
        *[
            F.struct(F.lit(g).alias("density_group"), F.lit(f).alias("font_size"), F.lit(s).alias("line_spacing"), F.lit(c).alias("letter_spacing"))
            for g, (f, s, c) in C.DENSITY_GROUPS.items()
        ]
    )
    return df.select("*", F.inline(presets))


def shift_grid(ids: DataFrame, stride: int, resolution: int = 1024, reach: int = 16) -> DataFrame:
    """Every id at every offset pair; offsets are 0, stride, … and the reach itself."""
    if not 0 < stride <= reach:
        raise ValueError("the stride must lie between 1 and the reach")
    if resolution <= reach:
        raise ValueError("the resolution must exceed the reach")
    offsets = F.array(*map(F.lit, sorted({*range(0, reach + 1, stride), reach})))
    grid = ids.select("id", F.explode(offsets).alias("x")).select("id", "x", F.explode(offsets).alias("y"))
    return grid.select(
        F.concat_ws("_", "id", "x", "y").alias("shift_id"), F.col("id").alias("base_id"), "x", "y",
        F.lit(resolution - reach).alias("inner_size"),
    )


def train_test_split(df: DataFrame, frac: float, seed: int, ids: list[str], exclude: Column | None = None) -> DataFrame:
    """Adds ``split``: an exact share of the eligible rows is ``test``, excluded rows are flagged ``excluded``."""
    if not 0.0 <= frac < 1.0:
        raise ValueError("the test share lies in [0, 1)")
    flag = F.lit(False) if exclude is None else F.coalesce(exclude, F.lit(False))
    eligible = df.where(~flag)
    marked = _first_by_hash(eligible, frac, seed, ids)
    return marked if exclude is None else marked.unionByName(df.where(flag).withColumn("split", F.lit("excluded")))


def _first_by_hash(df: DataFrame, frac: float, seed: int, ids: list[str]) -> DataFrame:
    """Adds ``split``, ``train`` for the first rows in the order of `hash_rank`.

    Counts of slices of the hash find the slice with the cut, and counts within it the hash at the cut: rows know their
    side by their hash. Only if the cut falls between rows of one hash, these are numbered.
    """
    hashed = df.withColumn("_h", digest(seed, *ids))
    first = lambda n: F.substring("_h", 1, n)
    counted = lambda rows, by: sorted(rows.groupBy(by.alias("s")).agg(F.count("*").alias("n")).toLocalIterator())
    slices = counted(hashed, first(SLICE_DIGITS // 2))  # at most 4,096 rows
    left = math.floor(sum(n for _, n in slices) * (1.0 - frac))

    def to_cut(found: list, left: int) -> tuple[str | None, int]:
        for name, n in found:
            if left < n:
                return name, left
            left -= n
        return None, left

    at, left = to_cut(slices, left)
    if at is None:
        return df.withColumn("split", F.lit("train"))
    inside = cut_lineage(hashed.where(first(len(at)) == at).select("_h"), "slice")  # a 4,096th of the hashes
    at, left = to_cut(counted(inside, first(SLICE_DIGITS)), left)
    at, left = to_cut(counted(inside.where(first(SLICE_DIGITS) == at), F.col("_h")), left)
    if not left:  # the cut lies before a hash: every row knows its side
        return hashed.withColumn("split", F.when(F.col("_h") < at, "train").otherwise("test")).drop("_h")
    clear = hashed.where(F.col("_h") != at).withColumn("split", F.when(F.col("_h") < at, "train").otherwise("test"))
    order = W.partitionBy("_h").orderBy(*ids)
    cut = hashed.where(F.col("_h") == at).withColumn("split", F.when(F.row_number().over(order) <= left, "train").otherwise("test"))
    return clear.unionByName(cut).drop("_h")


def sample_frac_by(df: DataFrame, column: str, fractions: dict, seed: int, ids: list[str]) -> DataFrame:
    """A hash-drawn share of each group; groups without an entry are left out."""
    share = None
    for key, f in fractions.items():
        cond = F.col(column) == key
        share = F.when(cond, F.lit(float(f))) if share is None else share.when(cond, F.lit(float(f)))
    return df.where(unit_hash(seed, *ids) < share.otherwise(F.lit(0.0)))


def cumulative_pages(pages: DataFrame) -> DataFrame:
    """For each prefix of a page's ordered blocks: the blocks, and their box clamped to the page, with moved polygons.

    Blocks without polygon are passed over, prefixes with an empty box are left out.
    """
    usable = F.transform(F.col("layout_dets"), lambda b, i: F.struct((i + 1).alias("no"), b.alias("b")))
    usable = F.filter(usable, lambda u: u["b"]["poly"].isNotNull() & (F.size(u["b"]["poly"]) > 0))
    xs = lambda u: F.filter(u["b"]["poly"], lambda v, i: i % 2 == 0)
    ys = lambda u: F.filter(u["b"]["poly"], lambda v, i: i % 2 == 1)
    prefixes = pages.withColumn("_u", usable).select(
        "page_id", "width", "height", "_u", F.posexplode("_u").alias("_i", "_last")
    ).withColumn("_p", F.slice("_u", F.lit(1), F.col("_i") + 1))
    boxed = prefixes.select(
        "page_id",
        F.col("_last.no").alias("prefix_no"),
        "_p",
        F.greatest(F.lit(0), F.floor(F.least(F.col("width"), F.array_min(F.flatten(F.transform("_p", xs))))).cast("int")).alias("x0"),
        F.greatest(F.lit(0), F.floor(F.least(F.col("height"), F.array_min(F.flatten(F.transform("_p", ys))))).cast("int")).alias("y0"),
        F.least(F.col("width"), F.ceil(F.greatest(F.lit(0.0), F.array_max(F.flatten(F.transform("_p", xs))))).cast("int")).alias("x1"),
        F.least(F.col("height"), F.ceil(F.greatest(F.lit(0.0), F.array_max(F.flatten(F.transform("_p", ys))))).cast("int")).alias("y1"),
    ).where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    moved = lambda q: F.transform(q, lambda v, i: v - F.when(i % 2 == 0, F.col("x0")).otherwise(F.col("y0")))
    return boxed.select(
        "page_id", "prefix_no", "x0", "y0", "x1", "y1",
        (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"),
        F.transform("_p", lambda u: F.struct(u["b"]["anno_id"].alias("anno_id"), u["b"]["text"].alias("text"), moved(u["b"]["poly"]).alias("poly"))).alias("layout_dets"),
    )
