"""Column functions on text: segmentation, cleaning and identifiers. All are built-in expressions but the edit distance, which Arrow batches carry to Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescale import constants as C
from pagescale.functions.edits import distances

STRINGS = "array<string>"


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, body) -> Column:
    """Bind a computed value for use in ``body`` so that it is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- whitespace, lines, words -------------------------------------------------------------------------------------


def strip(col: Column) -> Column:
    """Trim any Unicode white space at both ends."""
    return F.regexp_replace(col, C.EDGE_SPACE, "")


def normalize_ws(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, C.SPACES, " "))


def lines(col: Column) -> Column:
    return F.split(col, C.LINE_END)


def words(col: Column) -> Column:
    return F.filter(F.split(col, C.SPACES), lambda w: w != "")


def split_sentences(col: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by white space; blanks are dropped."""
    return F.filter(F.transform(F.split(col, C.SENTENCE_END), strip), lambda s: s != "")


def remove_bom(col: Column) -> Column:
    return F.replace(col, F.lit("\ufeff"), F.lit(""))


# --- numerals, chapters, sections ---------------------------------------------------------------------------------


def roman_to_int(col: Column) -> Column:
    """Subtractive Roman numerals of any case; the caller decides which ids are numerals."""
    letters = F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.upper(F.substr(col, i, F.lit(1))))
    value = lambda ch: F.element_at(F.create_map(*[F.lit(x) for kv in C.ROMAN.items() for x in kv]), ch)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("largest"))
    step = lambda acc, ch: F.struct(
        F.when(value(ch) < acc["largest"], acc["total"] - value(ch)).otherwise(acc["total"] + value(ch)).alias("total"),
        F.greatest(acc["largest"], value(ch)).alias("largest"),
    )
    return F.when(F.length(col) > 0, F.aggregate(F.reverse(letters), zero, step, lambda acc: acc["total"]))


def chapter_id(col: Column) -> Column:
    """Roman ids become decimal strings, every other id stays."""
    return F.when(col.rlike("(?i)^[IVXLCDM]+$"), roman_to_int(col).cast("string")).otherwise(col)


def _without_groups(pattern: str) -> str:
    """The pattern with plain groups that capture nothing; escaped brackets and those in character classes stay."""
    return re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?!\?)", lambda m: "(?:" if m[0] == "(" else m[0], pattern, flags=re.DOTALL)


def marked_sections(text: Column, marker: str) -> Column:
    """``array<struct<mark, body>>`` for each match of ``marker`` (one capture group); body runs to the next match."""
    found = F.lit(f"(?m){marker}")
    bodies = F.split(text, found, -1)
    return F.arrays_zip(F.regexp_extract_all(text, found, F.lit(1)).alias("mark"), F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))).alias("body"))


def split_chapters(text: Column, marker: str = C.CHAPTER_MARKER) -> Column:
    """``array<struct<chapter_id, body>>`` of non-empty chapters."""
    found = F.transform(
        marked_sections(text, marker),
        lambda s: F.struct(chapter_id(F.trim(s["mark"])).alias("chapter_id"), strip(s["body"]).alias("body")),
    )
    return F.filter(found, lambda s: s["body"] != "")


def split_headed_chapters(text: Column, marker: str = C.HEADED_MARKER) -> Column:
    """Bodies after a whole-line marker and its heading lines (blank or without lower-case letters)."""
    inner = _without_groups(marker)
    line = rf"^[^\S\n]*{inner}[^\S\n]*$"
    heading = r"(?-i:[^\p{Ll}\n]*(?:\n|\z))*+"
    pattern = rf"(?im){line}(?:\n|\z){heading}((?s:.*?))(?={line}|\z)"
    bodies = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), strip)
    return F.filter(bodies, lambda b: b != "")


def split_by_separator(text: Column, skip_first: int = C.SECTIONS_SKIPPED) -> Column:
    """Sections between lines of five or more hyphens; the first ``skip_first`` are front matter."""
    parts = F.filter(F.transform(F.split(text, r"(?m)^[^\S\n]*-{5,}[^\S\n]*$"), strip), lambda s: s != "")
    return F.when(F.size(parts) > skip_first, F.slice(parts, skip_first + 1, F.size(parts))).otherwise(
        F.array().cast(STRINGS)
    )


def extract_delimited(text: Column, start: str = C.LETTER_START, end: tuple[str, str] = C.LETTER_END) -> Column:
    """Regions from a start line to two consecutive end lines, or to the end of the text."""
    quoted = [r"\Q" + e + r"\E" for e in end]
    close = rf"^[^\S\n]*{quoted[0]}[^\S\n]*\n[^\S\n]*{quoted[1]}[^\S\n]*$"
    pattern = rf"(?im)^[^\S\n]*{start}(?s:.*?)(?:{close}|\z)"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip)


# --- balanced blocks ----------------------------------------------------------------------------------------------


def _cut_points(weights: Column, n: Column, eager: bool) -> Column:
    """Ends (exclusive, 1-based count of items) of the greedy groups: a group closes once it reaches total / n.

    ``eager`` forces a cut while the remaining items do not exceed the remaining groups, otherwise only on equality.
    The totals live in the accumulator so that they are evaluated once per row.
    """
    zero = F.struct(
        F.lit(0).alias("pos"),
        F.lit(0).cast("long").alias("filled"),
        F.size(weights).alias("items"),
        n.cast("int").alias("n"),
        F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w).alias("total"),
        F.array().cast("array<int>").alias("ends"),
    )

    def step(acc: Column, w: Column) -> Column:
        filled = acc["filled"] + w
        pos = acc["pos"] + 1
        items_left = acc["items"] - pos
        groups_left = acc["n"] - F.size(acc["ends"]) - 1
        forced = items_left <= groups_left if eager else items_left == groups_left
        full = (items_left > groups_left) & (filled * acc["n"] >= acc["total"])
        cut = (groups_left > 0) & (forced | full)
        return F.struct(
            pos.alias("pos"),
            F.when(cut, F.lit(0).cast("long")).otherwise(filled).alias("filled"),
            acc["items"].alias("items"),
            acc["n"].alias("n"),
            acc["total"].alias("total"),
            F.when(cut, F.concat(acc["ends"], F.array(pos))).otherwise(acc["ends"]).alias("ends"),
        )

    return F.aggregate(weights, zero, step, lambda acc: acc["ends"])


def _group_items(items: Column, weigh, n: Column | int, eager: bool) -> Column:
    if isinstance(n, int) and n <= 0:
        raise ValueError("the number of blocks must be positive")
    n = _lit(n)

    def blocks(its: Column, ends: Column) -> Column:
        def block(i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(ends, i - 1), F.size(its)))
            end = F.coalesce(F.get(ends, i), F.size(its))
            return F.array_join(F.slice(its, begin + 1, F.greatest(end - begin, F.lit(0))), " ")

        return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), block)

    return let(items, lambda its: let(_cut_points(F.transform(its, weigh), n, eager), lambda ends: blocks(its, ends)))


def chunk_by_chars(sentences: Column, n: Column | int) -> Column:
    """``n`` blocks of whole sentences with nearly equal character counts."""
    return _group_items(sentences, lambda s: F.length(s), n, eager=False)


def word_count(col: Column) -> Column:
    return F.size(words(col))


def spaced_words(col: Column) -> Column:
    """Words of a text without other white space than single spaces inside, as `normalize_ws` leaves it."""
    return F.when(col == "", 0).otherwise(F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit(""))) + 1)


def chunk_by_words(sentences: Column, n: Column | int, count=word_count) -> Column:
    """``n`` blocks of whole sentences with nearly equal word counts."""
    return _group_items(sentences, count, n, eager=True)


def word_total(sentences: Column, count=word_count) -> Column:
    return F.aggregate(sentences, F.lit(0), lambda a, s: a + count(s))


def equal_word_segments(col: Column, k: int = 5) -> Column:
    """``k`` runs of words; the first ``words mod k`` runs are one word longer."""
    if k <= 0:
        raise ValueError("k must be positive")

    def segments(ws: Column) -> Column:
        base, extra = F.floor(F.size(ws) / k).cast("int"), F.size(ws) % k

        def segment(i: Column) -> Column:
            start = i * base + F.least(i, extra)
            return F.array_join(F.slice(ws, start + 1, base + F.when(i < extra, 1).otherwise(0)), " ")

        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), segment)

    return let(words(col), segments)


def paragraphs(col: Column) -> Column:
    flat = strip(F.replace(col, F.lit("\n"), F.lit(" ")))
    return F.filter(F.transform(F.split(flat, r"(?U)\s{2,}"), strip), lambda p: p != "")


def wrap_lines(col: Column, width: Column | int) -> Column:
    """Greedy word wrap; a blank line stands between paragraphs; a word longer than the width is cut.

    Hyphenated words are kept together.
    """
    w = _lit(width).cast("string")
    pattern = F.concat(
        F.lit(r"\S.{0,"), (_lit(width) - 1).cast("string"), F.lit(r"}(?=\s|\z)|\S{"), w, F.lit("}")
    )
    wrapped = F.transform(paragraphs(col), lambda p: F.transform(F.regexp_extract_all(p, pattern, F.lit(0)), F.rtrim))
    spaced = F.flatten(F.transform(wrapped, lambda ls, i: F.when(i == 0, ls).otherwise(F.concat(F.array(F.lit("")), ls))))
    return let(spaced, lambda ls: F.when(F.size(ls) > 0, ls).otherwise(F.array(F.lit(""))))


# --- recognised output --------------------------------------------------------------------------------------------


def md_to_text(col: Column) -> Column:
    """Plain text of Markdown: images out, links unwrapped, list and heading marks cut, lines joined."""
    no_images = F.regexp_replace(col, C.MD_IMAGE, " ")
    no_links = F.regexp_replace(no_images, C.MD_LINK, "$1")
    kept = F.filter(F.transform(lines(no_links), strip), lambda x: x != "")
    return strip(F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, C.MD_MARKS, "")), " "))


def strip_grounding(col: Column, tagged_only: bool = True, drop_center: bool = False, math_ops: bool = True) -> Column:
    """Drop location tags and tidy what they leave behind; untagged text stays as it is when ``tagged_only``."""
    out = F.regexp_replace(col, C.GROUNDING_TAG, "")
    if math_ops:
        out = F.replace(F.replace(out, F.lit("\\coloneqq"), F.lit(":=")), F.lit("\\eqqcolon"), F.lit("=:"))
    if drop_center:
        out = F.replace(F.replace(out, F.lit("<center>"), F.lit("")), F.lit("</center>"), F.lit(""))
    out = F.replace(F.replace(out, F.lit("\n\n\n\n"), F.lit("\n\n")), F.lit("\n\n\n"), F.lit("\n\n"))
    return F.when(col.rlike(C.GROUNDING_TAG), out).otherwise(col) if tagged_only else out


def boxes(col: Column) -> Column:
    """``array<struct<label, box>>`` from location tags; lists that do not parse are skipped."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(col, F.lit(C.GROUNDING_TAG), F.lit(1)).alias("label"),
        F.regexp_extract_all(col, F.lit(C.GROUNDING_TAG), F.lit(2)).alias("raw"),
    )
    parsed = F.transform(
        pairs,
        lambda p: F.transform(
            F.coalesce(F.from_json(p["raw"], "array<array<double>>"), F.array().cast("array<array<double>>")),
            lambda b: F.struct(p["label"].alias("label"), b.alias("box")),
        ),
    )
    return F.filter(F.flatten(parsed), lambda s: (F.size(s["box"]) == 4) & ~F.exists(s["box"], lambda v: v.isNull()))


def image_refs_to_links(col: Column, page: Column) -> Column:
    """The n-th image tag of a page becomes a Markdown link to its crop."""
    parts = F.split(col, C.IMAGE_TAG)
    linked = F.transform(
        parts,
        lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(F.lit("![](images/"), page.cast("string"), F.lit("_"), (i - 1).cast("string"), F.lit(".jpg)\n"), p)
        ),
    )
    return F.array_join(linked, "")


def clean_formula(col: Column) -> Column:
    r"""Inside ``\[ … \]`` on one line: drop ``\quad (…)`` and trim."""
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(r"\\\[.*?\\\]"), F.lit(0)))

    def cleaned(m: Column) -> Column:
        inner = F.regexp_replace(F.substr(m, F.lit(3), F.length(m) - 4), r"\\quad\s*\([^)]*\)", "")
        return F.concat(F.lit("\\["), strip(inner), F.lit("\\]"))

    return F.aggregate(found, col, lambda acc, m: F.replace(acc, m, cleaned(m)))


def strip_fences(col: Column) -> Column:
    body = F.regexp_replace(strip(col), C.FENCE_START, "")
    return strip(F.regexp_replace(body, C.FENCE_END, ""))


def normalize_finish(col: Column) -> Column:
    return F.when(col == "length", "length").when(col.isNull() | (col == "fail"), "fail").otherwise("stop")


# --- identifiers --------------------------------------------------------------------------------------------------


def file_stem(col: Column) -> Column:
    """Base name without its last extension."""
    name = F.regexp_extract(col, r"([^/]*)/*\z", 1)
    return F.regexp_replace(name, r"(?s)(.)\.[^.]*\z", "$1")


def strip_shift_suffix(col: Column) -> Column:
    return F.regexp_replace(col, r"^(.+)_\d+_\d+$", "$1")


def suffix_number(col: Column) -> Column:
    """Trailing ``_digits`` as a number, -1 when absent."""
    return F.coalesce(F.regexp_extract(col, r"_(\d+)$", 1).try_cast("int"), F.lit(-1))


def suffix_base(col: Column) -> Column:
    return F.regexp_replace(col, r"^(.*)_\d+$", "$1")


def block_code(page: Column, block: Column) -> Column:
    label = F.regexp_replace(page, "[^0-9A-Za-z]", "")
    return F.concat(F.lit("C"), F.when(label == "", "X").otherwise(label), F.lit("B"), block.cast("string"))


def short_number(col: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros, as C's ``%g`` writes it."""
    rounded = F.format_string("%.5e", col.cast("double"))
    power = F.regexp_extract(rounded, r"e([+-]\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.format_string("%.10f", rounded.try_cast("double")), r"\.?0+$", "")
    short = F.regexp_replace(rounded, r"\.?0+e", "e")
    return F.when(col.isNotNull(), F.when(power.between(-4, 5), plain).otherwise(short))


def style_id(font: Column, line: Column, letter: Column) -> Column:
    return F.concat(F.lit("fs="), short_number(font), F.lit("|ls="), short_number(line), F.lit("|cs="), short_number(letter))


def group_id(resolution: Column, font: Column, line: Column, letter: Column) -> Column:
    return F.concat(F.lit("R="), resolution.cast("int").cast("string"), F.lit("|"), style_id(font, line, letter))


def text_len(col: Column) -> Column:
    return F.coalesce(F.length(col), F.lit(0))


def token_len(col: Column, pattern: str = r"\w+|[^\w\s]") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(col, F.lit(f"(?U){pattern}"), F.lit(0))), F.lit(0))


# --- scoring helpers ----------------------------------------------------------------------------------------------


def has_cjk(col: Column) -> Column:
    return F.coalesce(col.rlike("[\u4e00-\u9fa5]"), F.lit(False))


def tokens(col: Column, cjk: Column) -> Column:
    """White-space tokens; where ``cjk`` holds every ideograph is a token of its own and other runs stay whole."""
    spaced = F.when(cjk, F.regexp_replace(col, "([\u4e00-\u9fa5])", " $1 ")).otherwise(col)
    return F.coalesce(words(spaced), F.array().cast(STRINGS))


@F.pandas_udf(T.IntegerType())
def _edit_steps(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    known = a.notna() & b.notna()
    out[known] = distances(a[known].tolist(), b[known].tolist())
    return out


def edit_steps(a: Column, b: Column) -> Column:
    """Levenshtein distance; 0 for equal texts without a look at them, NULL where one is NULL."""
    differ = a != b
    return F.when(a == b, F.lit(0)).otherwise(_edit_steps(F.when(differ, a), F.when(differ, b)))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, 0 when both texts are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(0.0)).when(longest > 0, edit_steps(a, b) / longest).otherwise(F.lit(0.0))


def parse_width(col: Column) -> Column:
    """Trailing ``_digits`` of ``prefix_width``; NULL when absent."""
    return F.regexp_extract(col, r"_(\d+)$", 1).try_cast("int")


def parse_size(df, column: str = "id"):
    """Rows whose id ends in ``_width_height``, with base, ``w`` and ``h``."""
    pattern = r"^(.+)_(\d+)_(\d+)$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    return df.where(F.col(column).rlike(pattern)).select("*", part(1).alias("base"), part(2).try_cast("int").alias("w"), part(3).try_cast("int").alias("h"))
