"""SQL names for the column functions: inlined by the optimizer like any expression."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale import constants as C

def quoted(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_of(t: str) -> str:
    return f"regexp_replace({t}, {quoted(C.EDGE_SPACE)}, '')"


def replaced(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, {quoted(pattern)}, '{by}')"


def short_of(x: str) -> str:
    """A number as C's ``%g`` writes it, like the column function."""
    digits = f"format_string('%.5e', CAST({x} AS DOUBLE))"
    power = f"try_cast(regexp_extract({digits}, 'e([+-]\\\\d+)$', 1) AS INT)"
    plain = replaced(f"format_string('%.10f', try_cast({digits} AS DOUBLE))", r"\.?0+$", "")
    return f"CASE WHEN {power} BETWEEN -4 AND 5 THEN {plain} ELSE {replaced(digits, chr(92) + '.?0+e', 'e')} END"


def map_of(values: dict) -> str:
    return f"map({', '.join(f'{k!r}, {v!r}' + ('D' if isinstance(v, float) else '') for k, v in values.items())})"


GLYPHS, HEIGHTS = (map_of({font: size[i] for font, size in C.FONT_METRICS.items()}) for i in (0, 1))
MD_LINES = f"split({replaced(replaced('t', C.MD_IMAGE, ' '), C.MD_LINK, '$1')}, {quoted(C.LINE_END)})"

# name -> (arguments, result type, body); patterns and tables are those of the column functions
SQL_FUNCTIONS = {
    "normalize_ws": ("t STRING", "STRING", f"trim({replaced('t', C.SPACES, ' ')})"),
    "split_sentences": ("t STRING", "ARRAY<STRING>", f"filter(transform(split(t, {quoted(C.SENTENCE_END)}), s -> {strip_of('s')}), s -> s <> '')"),
    "ocr_edit_dist": (
        "p STRING, g STRING", "DOUBLE",
        "CASE WHEN greatest(length(p), length(g)) = 0 THEN 0D ELSE levenshtein(p, g) / greatest(length(p), length(g)) END",
    ),
    "has_cjk": ("t STRING", "BOOLEAN", "coalesce(t rlike '[一-龥]', false)"),
    "file_stem": ("p STRING", "STRING", r"regexp_replace(regexp_extract(p, '([^/]*)/*\\z', 1), '(?s)(.)\\.[^.]*\\z', '$1')"),
    "strip_shift_suffix": ("i STRING", "STRING", r"regexp_replace(i, '^(.+)_\\d+_\\d+$', '$1')"),
    "strip_fences": ("t STRING", "STRING", strip_of(replaced(replaced(strip_of("t"), C.FENCE_START, ""), C.FENCE_END, ""))),
    "md_to_text": (
        "t STRING", "STRING",
        strip_of(f"array_join(transform(filter(transform({MD_LINES}, x -> {strip_of('x')}), x -> x <> ''), x -> {replaced('x', C.MD_MARKS, '')}), ' ')"),
    ),
    "roman_to_int": (
        "r STRING", "INT",
        f"CASE WHEN length(r) > 0 THEN aggregate(reverse(transform(sequence(1, length(r)), i -> element_at({map_of(C.ROMAN)}, "
        "upper(substr(r, i, 1))))), named_struct('t', 0, 'm', 0), "
        "(a, v) -> named_struct('t', CASE WHEN v < a.m THEN a.t - v ELSE a.t + v END, 'm', greatest(a.m, v)), a -> a.t) END",
    ),
    "patch_density": (
        "w DOUBLE, h DOUBLE, cw DOUBLE, ch DOUBLE, r DOUBLE", "DOUBLE",
        "CASE WHEN w > 0 AND h > 0 AND cw > 0 AND ch > 0 AND r > 0 THEN 256D / (cw * (r / w) * ch * (r / h)) ELSE 0D END",
    ),
    "vision_tokens": ("r DOUBLE", "DOUBLE", "power(r / 64, 2)"),
    "information_density": (
        "d DOUBLE, font INT, line DOUBLE, letter DOUBLE", "DOUBLE",
        f"d * element_at({GLYPHS}, font) * element_at({HEIGHTS}, font) / "
        f"((element_at({GLYPHS}, font) + letter) * (element_at({HEIGHTS}, font) + line))",
    ),
    "group_id": (
        "r DOUBLE, f DOUBLE, l DOUBLE, c DOUBLE", "STRING",
        f"concat('R=', CAST(CAST(r AS INT) AS STRING), '|fs=', {short_of('f')}, '|ls=', {short_of('l')}, '|cs=', {short_of('c')})",
    ),
    "tile_grid": ("w INT, h INT", "STRUCT<cols INT, rows INT>", None),
    "image_tokens": ("w INT, h INT", "INT", None),
}


def _tile_body() -> str:
    from pagescale.functions.geometry import _tile_shapes

    shapes = ", ".join(f"named_struct('cols', {i}, 'rows', {j})" for i, j in _tile_shapes(C.MIN_TILES, C.MAX_TILES))
    gap = "abs(w / h - s.cols / s.rows)"
    return (
        f"aggregate(array({shapes}), named_struct('gap', double('inf'), 'cols', 1, 'rows', 1), (b, s) -> CASE WHEN {gap} < b.gap OR "
        f"({gap} = b.gap AND w * h > 0.5D * 640 * 640 * s.cols * s.rows) THEN named_struct('gap', {gap}, 'cols', s.cols, 'rows', s.rows) "
        "ELSE b END, b -> named_struct('cols', b.cols, 'rows', b.rows))"
    )


def register_functions(spark: SparkSession) -> list[str]:
    """Create the session's SQL functions and return their names."""
    for name, (args, result, body) in SQL_FUNCTIONS.items():
        if name == "tile_grid":
            body = _tile_body()
        if name == "image_tokens":
            body = (
                "273 + CASE WHEN w <= 640 AND h <= 640 THEN 0 ELSE element_at(transform(array(tile_grid(w, h)), "
                "t -> CASE WHEN t.cols > 1 OR t.rows > 1 THEN t.rows * 10 * (t.cols * 10 + 1) ELSE 0 END), 1) END"
            )
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)


def let_of(value: str, name: str, body: str) -> str:
    """A SQL value bound to a name for use in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


SENTENCES = f"filter(transform(split(trim({replaced('t', C.SPACES, ' ')}), {quoted(C.SENTENCE_END)}), s -> {strip_of('s')}), s -> s <> '')"
BLOCKS = let_of(
    f"filter(split(t, {quoted(C.SPACES)}), x -> x <> '')", "w",
    "transform(sequence(0, k - 1), i -> array_join(slice(w, i * CAST(size(w) div k AS INT) + least(i, CAST(size(w) % k AS INT)) + 1, "
    "CAST(size(w) div k AS INT) + CASE WHEN i < size(w) % k THEN 1 ELSE 0 END), ' '))",
)
FOUND = "concat('(?m)', marker)"
CHAPTERS = (
    f"filter(transform(arrays_zip(regexp_extract_all(t, {FOUND}, 1), {let_of(f'split(t, {FOUND})', 'p', 'slice(p, 2, greatest(size(p) - 1, 0))')}), "
    f"x -> named_struct('mark', trim(x['0']), 'body', {strip_of(chr(120) + '[' + chr(39) + '1' + chr(39) + ']')})), x -> x.body <> '')"
)
# name -> (arguments, columns, query): segmenters that give a row for each part, called with LATERAL. A query is one generator
# over built-in functions: Spark then cuts the rows of the caller where they are and joins nothing.
TABLE_FUNCTIONS = {
    "sentence_table": ("t STRING", "pos INT, part STRING", f"SELECT pos, part FROM posexplode({SENTENCES}) AS e(pos, part)"),
    "block_table": ("t STRING, k INT", "pos INT, part STRING", f"SELECT pos, part FROM posexplode({BLOCKS}) AS e(pos, part)"),
    "chapter_table": (
        "t STRING, marker STRING", "pos INT, chapter_id STRING, body STRING",
        f"SELECT pos, s.mark AS chapter_id, s.body FROM posexplode({CHAPTERS}) AS e(pos, s)",
    ),
}


def register_tables(spark: SparkSession) -> list[str]:
    """Create the session's table functions (and the scalar ones that they use) and return their names."""
    register_functions(spark)
    for name, (args, columns, query) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {query}")
    return list(TABLE_FUNCTIONS)


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """Wrap a user's tokenizer as an Arrow-batched column function; equal texts of a batch are counted once."""

    @F.pandas_udf(T.IntegerType())
    def counted(texts: pd.Series) -> pd.Series:
        known = {t: count(t) if isinstance(t, str) else 0 for t in texts.unique()}
        return texts.map(known).fillna(0).astype("int32")

    return counted
