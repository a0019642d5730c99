"""Text functions against plain loops and hand-made edge cases."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import text as X
from pagescale.operators import segmentation as G


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def loop_chunks(sentences, n, weigh, eager):
    if not sentences:
        return [""] * n
    total = sum(map(weigh, sentences))
    out, cur, filled = [], [], 0
    for i, s in enumerate(sentences):
        cur.append(s)
        filled += weigh(s)
        left, open_ = len(sentences) - i - 1, n - len(out) - 1
        forced = left <= open_ if eager else left == open_
        if open_ > 0 and (forced or (left > open_ and filled >= total / n)):
            out.append(" ".join(cur))
            cur, filled = [], 0
    out.append(" ".join(cur))
    return out + [""] * (n - len(out))


def test_chunking_matches_loop(spark):
    rnd = random.Random(5)
    rows = [([" ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 6))) + "." for _ in range(rnd.randint(0, 14))],) for _ in range(200)]
    rows += [(["a."],), (["x" * 90 + "."] + ["b."] * 3,), (["aa bb."] * 4,)]
    df = spark.createDataFrame(rows, "s array<string>")
    for n in (1, 3, 4, 7):
        got = df.select("s", X.chunk_by_chars(F.col("s"), n).alias("c"), X.chunk_by_words(F.col("s"), n).alias("w")).collect()
        for r in got:
            assert r.c == loop_chunks(r.s, n, len, False)
            assert r.w == loop_chunks(r.s, n, lambda t: len(t.split()), True)
            assert len(r.c) == n and " ".join(b for b in r.c if b) == " ".join(r.s)
    with pytest.raises(ValueError):
        X.chunk_by_chars(F.col("s"), 0)


def test_pagination_matches_loop(spark):
    rnd = random.Random(8)
    bodies = [[" ".join("w" * rnd.randint(1, 5) for _ in range(rnd.randint(1, 5))) + "." for _ in range(rnd.randint(0, 40))] for _ in range(6)]
    df = spark.createDataFrame([("b", [" ".join(b) for b in bodies])], "book_name string, bodies array<string>")
    words = lambda s: sum(len(x.split()) for x in s)
    sent = lambda t: [x for x in t.replace(". ", ".\n").split("\n") if x]
    for ref, need, pages in ((0, 0, 3), (2, 2, 2), (1, 1, 1)):
        base = bodies[ref if len(bodies) > need else 0]
        want = []
        for b in bodies:
            if not b:
                continue
            k = max(1, words(b) // max(words(base), 1))
            for piece in loop_chunks(b, k, lambda t: len(t.split()), True):
                if not piece:
                    continue
                parts = [piece] if pages == 1 else loop_chunks(sent(piece), pages, lambda t: len(t.split()), True)
                want += [loop_chunks(sent(p), 4, len, False) for p in parts if p]
        got = G.paginate(df, F.col("bodies"), ref, need, pages, 4).orderBy(F.col("page_id").cast("int")).collect()
        assert [r.blocks for r in got] == want
        assert [r.page_id for r in got] == [str(i + 1) for i in range(len(want))]


def test_wrap_matches_textwrap(spark):
    rnd = random.Random(2)
    texts = [" ".join("x" * rnd.randint(1, 12) for _ in range(rnd.randint(1, 60))) for _ in range(40)] + ["one  two\nthree   four", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for width in (12, 20, 41):
        for r in df.select("t", X.wrap_lines(F.col("t"), width).alias("l")).collect():
            want = []
            for p in [p.strip() for p in __import__("re").split(r"\s{2,}", r.t.replace("\n", " ").strip()) if p.strip()]:
                want += textwrap.wrap(p, width, break_on_hyphens=False) + [""]
            assert r.l == (want[:-1] or [""])


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance(spark):
    rnd = random.Random(3)
    rows = [("", ""), ("", "abc"), ("abc", "abc"), ("éa", "ea"), ("頁a", "a")]
    for _ in range(150):
        a = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 50)))
        b = list(a)
        for _ in range(rnd.randint(0, 30)):
            b.insert(rnd.randint(0, len(b)), rnd.choice("xyé")) if rnd.random() < 0.5 or not b else b.pop(rnd.randrange(len(b)))
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", X.edit_distance(F.col("a"), F.col("b")).alias("d"), X.edit_distance(F.col("b"), F.col("a")).alias("e")).collect():
        n = max(len(r.a), len(r.b))
        assert r.d == r.e == pytest.approx(levenshtein(r.a, r.b) / n if n else 0.0)


def test_segment_forms(spark):
    text = "front\nCHAPTER IV. Foo\nBody one.\n\n  CHAPTER 12\nX y.\nCHAPTER A1 z\n\nCHAPTER MCM\nend"
    got = one(spark, X.split_chapters(F.lit(text)))
    assert [(c.chapter_id, c.body) for c in got] == [("4", "Body one."), ("12", "X y."), ("1900", "end")]
    headed = "x\nCHAPTER I.\nTITLE HERE\n\nBody here.\nmore\nCHAPTER II.\n\nChapter 3.\nCHAPTER IV.\nHEAD\nLast"
    assert one(spark, X.split_headed_chapters(F.lit(headed))) == ["Body here.\nmore", "Last"]
    assert one(spark, X.split_by_separator(F.lit("a\n-----\nb\n------\n-----\nc\n-----\nd\n  ------- \ne\n-----"))) == ["d", "e"]
    assert one(spark, X.split_by_separator(F.lit("a\n-----\nb"))) == []
    letters = "a\n_Dear Pierrepont:_ hi\nb\nYour affectionate father,\nJOHN GRAHAM.\nzz\n_Dear  Pierrepont:_\nq\nyour affectionate father,\nnope"
    assert one(spark, X.extract_delimited(F.lit(letters))) == [
        "_Dear Pierrepont:_ hi\nb\nYour affectionate father,\nJOHN GRAHAM.", "_Dear  Pierrepont:_\nq\nyour affectionate father,\nnope"
    ]


@pytest.mark.parametrize("raw,want", [("MCMXCIV", 1994), ("iv", 4), ("IIII", 4), ("", None)])
def test_roman(spark, raw, want):
    assert one(spark, X.roman_to_int(F.lit(raw))) == want


def test_cleaning_edges(spark):
    assert one(spark, X.md_to_text(F.lit("1. - **x** [a](b)\n\n![i](j)\n> q"))) == "- **x** a q"
    assert one(spark, X.strip_fences(F.lit("```md\nabc\n```"))) == "abc"
    assert one(spark, X.strip_fences(F.lit("abc"))) == "abc"
    tag = "<|ref|>im\nage<|/ref|><|det|>[[1, 2, 3, 4],[5,6,7,8]]<|/det|>"
    assert one(spark, X.strip_grounding(F.lit(f"a{tag}\n\n\n\nb\\coloneqq"))) == "a\n\nb:="
    assert one(spark, X.strip_grounding(F.lit("a\n\n\nb\\coloneqq"))) == "a\n\n\nb\\coloneqq"
    bad = "<|ref|>t<|/ref|><|det|>[[bad<|/det|>"
    assert [b.box for b in one(spark, X.boxes(F.lit(tag + bad)))] == [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]]
    assert one(spark, X.clean_formula(F.lit("x \\[ a \\quad (3) \\] y \\[b\\]"))) == "x \\[a\\] y \\[b\\]"
    assert one(spark, X.file_stem(F.lit("/a/b/c.tar.gz"))) == "c.tar"
    assert one(spark, X.suffix_number(F.lit("plain"))) == -1
    assert one(spark, X.group_id(F.lit(512), F.lit(28.0), F.lit(6), F.lit(-1.5))) == "R=512|fs=28|ls=6|cs=-1.5"
    assert one(spark, X.normalize_ws(F.lit("a  b\t\nc "))) == "a b c"
    assert one(spark, X.remove_bom(F.lit("﻿x"))) == "x"


def test_repeated_ngrams_rule(spark):
    rnd = random.Random(4)
    toks = [rnd.choice("abc") for _ in range(60)]
    n, window, white = 3, 12, {"c"}
    want = set()
    for t in range(n, len(toks)):
        prefix = toks[t - n + 1 : t]
        banned = {toks[i + n - 1] for i in range(max(0, t - window), t - n + 1) if toks[i : i + n - 1] == prefix}
        if toks[t] in banned - white:
            want.add(t)
    df = spark.createDataFrame([(1, " ".join(toks))], "doc_id long, text string")
    got = {r.token_pos for r in G.repeated_ngrams(df, n, window, ("c",)).collect()}
    assert got == want
    with pytest.raises(ValueError):
        G.repeated_ngrams(df, 1, 5)


def test_constants_are_consistent():
    assert set(C.DROP_TOP) == set(C.ERROR_CAP) == set(C.RESOLUTIONS)


def test_short_number_is_percent_g(spark):
    values = [0.0, 28.0, -1.5, 0.1, 1234567.0, 0.00001234, 0.000123456789, 999999.5, 123456.0, 1e100, 100000.0, 2.5e-7]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", X.short_number(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in rows} == {v: "%g" % v for v in values} | {None: None}


def test_markers_may_hold_escaped_brackets(spark):
    df = spark.createDataFrame([("(1) one\n(2) two (x)\n",)], "t string")
    got = df.select(X.marked_sections(F.col("t"), r"^\((\d+)\)").alias("s")).first().s
    assert [(r["mark"], r["body"].strip()) for r in got] == [("1", "one"), ("2", "two (x)")]
    got = df.select(X.marked_sections(F.col("t"), r"^[(](\d+)[)]").alias("s")).first().s
    assert [r["mark"] for r in got] == ["1", "2"]


def test_sql_functions_equal_column_functions(spark):
    from pagescale.functions.registry import register_functions

    register_functions(spark)
    texts = ["", "  ", "\n```json\n{a}\n```\n", "```\nx\n```", "\u00a0a. b!\u00a0 c?\u00a0", "- [l](u)\r\n\u00a0* ![i](j) y\n3. z", None, "MCMXCIV", "x\u2003y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("normalize_ws", "split_sentences", "strip_fences", "md_to_text", "strip_shift_suffix", "file_stem", "has_cjk"):
        for r in df.select(F.expr(f"{name}(t)").alias("a"), getattr(X, name)(F.col("t")).alias("b")).collect():
            assert r.a == r.b, name
    for v in (1234567.0, 0.00001234567, 28.5, -1.0, 100000.0, 999999.5, 0.0):
        row = spark.range(1).select(F.expr(f"group_id(512, {v}D, 6, {-v}D)").alias("a"), X.group_id(F.lit(512), F.lit(v), F.lit(6), F.lit(-v)).alias("b")).first()
        assert row.a == row.b
    row = spark.range(1).select(F.expr("roman_to_int('mcmxciv')").alias("a"), F.expr("roman_to_int('')").alias("b")).first()
    assert (row.a, row.b) == (1994, None)


def test_segmenters_as_table_functions(spark):
    from pagescale.functions.registry import register_tables

    register_tables(spark)
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT * FROM sentence_table('A b.  C! d')") == [(0, "A b."), (1, "C!"), (2, "d")]
    assert rows("SELECT * FROM block_table('a b c d e', 2)") == [(0, "a b c"), (1, "d e")]
    text = "Chapter 1 : x\\nfirst\\nCHAPTER 2:\\nsecond"
    assert rows(f"SELECT * FROM chapter_table('{text}', '(?i)^Chapter\\\\s+(\\\\d+)\\\\s*:[^\\\\n]*')") == [(0, "1", "first"), (1, "2", "second")]


def test_next_wrap_moves_towards_the_square(spark):
    from pagescale.functions.geometry import next_wrap

    rows = [(100, 4.0, 50), (100, 0.25, 200), (100, 1.0, 100), (100, 1.11, 95), (100, 0.899, 105), (22, 9.0, 20), (390, 0.5, 400), (100, float("inf"), 100), (100, 0.0, 100), (100, float("nan"), 100), (3, 1.2, 20)]
    df = spark.createDataFrame([r[:2] for r in rows], "current int, ratio double")
    assert [r.n for r in df.select(next_wrap(F.col("current"), F.col("ratio")).alias("n")).collect()] == [r[2] for r in rows]


def test_edit_distances_of_batches(spark):
    """pairs of a batch go through the columns together, whatever their letters and lengths."""
    import random

    from pagescale.functions.edits import distance, distances

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abé字😀") for _ in range(n))
    xs = [text(rnd.choice([0, 1, 63, 64, 65, 127, 128, 129])) for _ in range(400)]
    ys = [x[: rnd.randint(0, len(x))] if rnd.random() < 0.4 else text(rnd.randint(0, 150)) for x in xs]
    want = [plain(x, y) for x, y in zip(xs, ys)]
    assert distances(xs, ys).tolist() == want and [distance(x, y) for x, y in zip(xs, ys)] == want


def test_lateral_segmenters_join_nothing(spark):
    """every call joined the texts with their own distinct values."""
    from pagescale.functions.registry import register_tables

    register_tables(spark)
    spark.createDataFrame([(1, "A b.  C! d"), (1, "A b.  C! d"), (2, None)], "i int, t string").createOrReplaceTempView("lateral_texts")
    for call in ("sentence_table(d.t)", "block_table(d.t, 2)", "chapter_table(d.t, '^([A-Z])')"):
        df = spark.sql(f"SELECT i, s.* FROM lateral_texts d, LATERAL {call} s")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        assert {r.i for r in df.collect()} == {1} or call.startswith("block")


def test_sections_without_a_look_ahead(spark):
    """F8: the text was tried at every letter, and once for marks and once for bodies."""
    df = spark.createDataFrame([("x\n\n1: a\n\n 2:b\n3:",)], "t string")
    found = X.marked_sections(F.col("t"), r"^\s*(\d+):")
    assert [(r["mark"], r["body"]) for r in df.select(found.alias("s")).first().s] == [("1", " a\n"), ("2", "b\n"), ("3", "")]
    assert ".*?" not in df.select(found)._jdf.queryExecution().analyzed().toString()
