"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line that many documents of one host share is furniture: menus, notices,
footers. Normalised lines are hashed, distinct documents are counted per host and
line, lines above both limits are removed, and a document of which too little is
left is rejected, as is one that fails the base rules on its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"  # the ASCII white space that separates words
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is furniture of a host if more distinct documents than this hold it ...
MAX_DOCS = 50
#: ... and more than this share of the host's distinct documents.
MAX_SHARE = 0.005
#: A document that lost lines is rejected if fewer words than this are left.
MIN_LEFT = 20


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text: what stands between ASCII white space."""
    return F.filter(F.split(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)), " "), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included.

    Windows are told apart by a 64-bit hash within one document.
    """

    def covered(spots: Column) -> Column:
        again = F.filter(
            spots,
            lambda s, i: F.coalesce(F.get(spots, i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(spots, i + 1)["h"] == s["h"], F.lit(False)),
        )
        return let(
            F.sort_array(F.transform(again, lambda s: s["at"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
                F.lit(0).cast("long"), lambda n, x: n + x,
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
    )
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), covered))


def base_columns(text: Column) -> dict[str, Column]:
    """The base figures of a text and whether the base rules fail."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    figures = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")),
    )
    n_words, n_repeat = F.col("figures.n_words"), F.col("figures.n_repeat_words")
    return {
        "figures": figures,
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")),
        "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words),
    }


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), "[ \\t-\\r]+", " "))


def _page() -> Column:
    """A document's content on its host: rows with equal text and source share it."""
    return F.xxhash64("source", "text")


def _line_key(line: Column) -> Column:
    """A normalised line on its host, as 64 bits."""
    return F.xxhash64("source", normal_line(line))


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: page, host and line hashes, place in the text and number of words."""
    return (
        docs.select("source", _page().alias("page"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .filter(F.length(F.translate("line", SPACE, "")) > 0)
        .select(
            "page", F.xxhash64("source").alias("host"), "at", _line_key(F.col("line")).alias("line"),
            F.size(words_of(F.col("line"))).alias("words"),
        )
    )


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Hashes ``line`` of the lines above both limits of their host, with the documents that hold them.

    Distinct documents are distinct texts: a document and its exact copies count
    once, so that a page is not taken for furniture because it was crawled often.
    """
    counts = (
        _lines(docs).select("host", "line", "page").distinct()
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs)
    )
    hosts = (
        docs.select(F.xxhash64("source").alias("host"), _page().alias("page")).distinct()
        .groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    )
    return counts.join(hosts, "host").filter(F.col("docs") > max_share * F.col("host_docs")).select("line", "docs")


def assess(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: int = MIN_LEFT) -> DataFrame:
    """Base figures and verdict of every row of ``docs`` (doc_id, text, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and n_lost_words (words in lines above the limits).
    ``kept`` is false if the base rules fail, or if lines were removed and fewer
    than ``min_left`` words are left. A NULL text has no words and fails; a NULL
    source is a host of its own; rows that share host and text get the same
    verdict; a NULL id stays NULL. An empty table gives an empty result; other
    columns are not read.
    """
    return _verdicts(docs.select("doc_id", "text", "source"), [], max_docs, max_share, min_left).drop("text")


def apply_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: int = MIN_LEFT) -> DataFrame:
    """The documents that ``assess`` keeps, without the lines above the limits.

    Every column of ``docs`` stays as it is but ``text``, and ``n_chars`` where
    there is one, which counts the characters of the new text.
    """
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text", "source")
    kept = _verdicts(own, ["row"], max_docs, max_share, min_left).filter("kept")
    new = {"text": F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in names])


def _verdicts(docs: DataFrame, keep: list[str], max_docs: int, max_share: float, min_left: int) -> DataFrame:
    lost = (
        _lines(docs).join(frequent_lines(docs, max_docs, max_share), "line").select("page", "at", "line", "words").distinct()
        .groupBy("page").agg(F.sum("words").alias("lost"), F.collect_set("line").alias("gone"))
    )
    base = base_columns(F.col("text"))
    rows = (
        docs.withColumn("page", _page()).join(lost, "page", "left")
        .withColumn("figures", base["figures"])
        .withColumn("lost", F.coalesce("lost", F.lit(0)))
    )
    left = F.col("figures.n_words") - F.col("lost")
    depleted = (F.col("lost") > 0) & (left < min_left)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), lambda line: ~F.array_contains(F.col("gone"), _line_key(line))), "\n")
    )
    return rows.select(
        *keep, "doc_id", "figures.n_words", base["word_chars"].alias("word_chars"), base["n_symbols"].alias("n_symbols"),
        base["n_dup_lines"].alias("n_dup_lines"), "figures.n_repeat_words", base["base_failed"].alias("base_failed"),
        (~base["base_failed"] & ~depleted).alias("kept"), F.col("lost").alias("n_lost_words"), text.alias("text"),
    )
