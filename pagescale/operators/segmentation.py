"""Books to chapters, pages and blocks. A book is one row; every cut is a row-local expression, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagescale import constants as C
from pagescale.functions import text as X
from pagescale.session import spread


def chapters(df: DataFrame, text: str = "text", marker: str = C.CHAPTER_MARKER) -> DataFrame:
    """One row per chapter with its position in the book."""
    parts = X.split_chapters(F.col(text), marker)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("chapter_no", "_c")).select(
        "*", "_c.chapter_id", "_c.body"
    ).drop("_c")


def sections(df: DataFrame, parts: Column, text: str = "text") -> DataFrame:
    """One row per section of an array expression; ``section_id`` counts from 1."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(parts).alias("_p", "body")).withColumn(
        "section_id", (F.col("_p") + 1).cast("string")
    ).drop("_p")


def _pages_of(bodies: Column, ref_index: int, needs_more_than: int, chunk_num: int) -> Column:
    """All pages of a book in order: bodies -> virtual chapters -> pages, empty pieces skipped."""
    as_sentences = F.transform(bodies, lambda b: X.split_sentences(X.normalize_ws(b)))

    count = X.spaced_words  # sentences and what is joined from them hold single spaces only

    def page_texts(chapter_list: Column) -> Column:
        pick = F.when(F.size(chapter_list) > needs_more_than, F.lit(ref_index)).otherwise(F.lit(0))
        ref = F.greatest(X.word_total(F.coalesce(F.get(chapter_list, pick), F.array().cast("array<string>")), count), F.lit(1))

        def of_chapter(sentences: Column, ref: Column) -> Column:
            virtual = F.greatest(F.lit(1), F.floor(X.word_total(sentences, count) / ref).cast("int"))
            pieces = X.let(virtual, lambda n: F.filter(X.chunk_by_words(sentences, n, count), lambda t: t != ""))
            if chunk_num <= 1:
                return pieces
            return F.flatten(
                F.transform(pieces, lambda t: F.filter(X.chunk_by_words(X.split_sentences(t), chunk_num, count), lambda p: p != ""))
            )

        # the words of the reference chapter are counted once a book, those of a chapter once for its number of pieces
        filled = F.filter(chapter_list, lambda s: F.size(s) > 0)
        return X.let(ref, lambda r: F.flatten(F.transform(filled, lambda s: of_chapter(s, r))))

    return X.let(as_sentences, page_texts)


def paginate(
    df: DataFrame, bodies: Column, ref_index: int = 0, needs_more_than: int | None = None, chunk_num: int = 6, blocks: int = 4
) -> DataFrame:
    """Pages of each book with their sentence blocks; ``page_id`` counts through the book.

    A chapter longer than the reference chapter is first cut into that many virtual chapters. ``chunk_num=1`` leaves out
    the page level.
    """
    limit = ref_index if needs_more_than is None else needs_more_than
    paged = df.select("book_name", F.posexplode(_pages_of(bodies, ref_index, limit, chunk_num)).alias("_p", "page_text"))
    return paged.select(
        "book_name",
        (F.col("_p") + 1).cast("string").alias("page_id"),
        X.chunk_by_chars(X.split_sentences(F.col("page_text")), blocks).alias("blocks"),
    )


def to_wide_blocks(df: DataFrame, n: int, blocks: str = "blocks") -> DataFrame:
    """``block1`` … ``blockN``; missing blocks are empty strings."""
    rest = [c for c in df.columns if c != blocks]
    return df.select(*rest, *[F.coalesce(F.get(F.col(blocks), F.lit(i)), F.lit("")).alias(f"block{i + 1}") for i in range(n)])


def unpivot_blocks(df: DataFrame, ids: list[str], page: str = "page_id") -> DataFrame:
    """Wide to long: key ``page_block``, numeric block order, blanks dropped."""
    names = sorted((c for c in df.columns if c.startswith("block") and c[5:].isdigit()), key=lambda c: int(c[5:]))
    long = df.unpivot(ids, names, "block_name", "text").where(X.strip(F.col("text")) != "")
    return long.select(
        *ids,
        F.substring("block_name", 6, 9).cast("int").alias("block_no"),
        F.concat_ws("_", F.col(page), F.col("block_name")).alias("block_key"),
        X.strip(F.col("text")).alias("text"),
    )


def group_blocks_by_page(long: DataFrame, book: str | None = None) -> DataFrame:
    """The ordered block list of every page over all records of that page, optionally of one book.

    The list stays one row per block in a range-partitioned order, so that a page with very many records still spreads
    over tasks.
    """
    df = long if book is None else long.where(F.col("book_name") == book)
    return df.select("page_id", "book_name", "block_no", "text").sort("page_id", "book_name", "block_no")


def segment_combinations(df: DataFrame, segments: str = "segments", k: int = 5) -> DataFrame:
    """All non-empty subsets of ``k`` segments: longest first, numbered lexicographically within a size."""
    from itertools import combinations

    subsets = [(size, no, c) for size in range(k, 0, -1) for no, c in enumerate(combinations(range(k), size), start=1)]
    table = F.array(
        *[F.struct(F.lit(s).alias("size"), F.lit(n).alias("no"), F.array(*map(F.lit, c)).alias("idx")) for s, n, c in subsets]
    )
    rest = [c for c in df.columns if c != segments]
    picked = F.filter(F.transform(F.col("_s.idx"), lambda i: F.get(F.col(segments), i)), lambda t: t != "")
    return df.select(*rest, segments, F.explode(table).alias("_s")).select(
        *rest, F.col("_s.size").alias("n_segments"), F.col("_s.no").alias("combo_idx"), F.array_join(picked, " ").alias("text")
    )


def page_concat(df: DataFrame) -> DataFrame:
    """Pages with the page-break line that ends each, in reading order; pages without content are left out.

    The text of a document is its pieces one after the other. They stay one row per page in a range-partitioned order, so
    that a document with very many pages still spreads.
    """
    piece = F.concat(F.col("content"), F.lit("\n" + C.PAGE_BREAK + "\n"))
    return df.where(F.col("content").isNotNull()).select("doc_id", "page", piece.alias("piece")).sort("doc_id", "page")


def repeated_ngrams(df: DataFrame, n: int, window: int, whitelist: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """Tokens that repeat an n-gram started at most ``window - n + 1`` tokens earlier in the same text.

    The texts move once, by document; grams are then compared within their document without a further exchange.
    """
    if n < 2 or window <= 0:
        raise ValueError("n must be at least 2 and the window positive")
    toks = spread(df, key).select(key, X.words(F.col("text")).alias("t"))
    grams = toks.where(F.size("t") >= n).select(
        key,
        F.posexplode(
            F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.slice("t", i, n))
        ).alias("pos", "gram"),
    )
    before = F.lag("pos").over(W.partitionBy(key, "gram").orderBy("pos"))
    hit = grams.withColumn("prev", before).where(F.col("pos") - F.col("prev") <= window - n + 1)
    token = F.element_at("gram", -1)
    hit = hit.select(key, (F.col("pos") + n - 1).alias("token_pos"), token.alias("token"))
    return hit.where(~F.col("token").isin(*whitelist)) if whitelist else hit


def repetition_rate(df: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Repeated tokens over all tokens per document."""
    sizes = df.select(key, F.size(X.words(F.col("text"))).alias("n_tokens"))
    per_doc = hits.groupBy(key).agg(F.count("*").alias("n_repeated"))
    return sizes.join(per_doc, key, "left").select(
        key,
        "n_tokens",
        F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce(F.try_divide(F.coalesce("n_repeated", F.lit(0)), F.col("n_tokens")), F.lit(0.0)).alias("rate"),
    )
