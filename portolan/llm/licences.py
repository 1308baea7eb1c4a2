"""Licence scans with a trained paragraph classifier, in DataFrame functions only.

A paragraph is a window over the words of the whole text, line ends or not, long
enough to hold any notice; windows overlap by half, so that each notice lies whole
in one of them. A multinomial logistic regression over sparse word n-grams tells
licence families and an unknown class apart. It is trained on pieces of the
reference notices below and on a bounded sample of the corpus's own windows as
unknown; windows kept out of training set the cut-off of the unknown class. Every
family above the cut-off is confirmed by comparison with its notices: enough of
the notice's word pairs have to stand in the window in the notice's order. Where
confirmed notices overlap, the one with the most pairs holds the place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm.common import stored

# Usual notices of each licence family.
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-only"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and related rights (CC0 1.0 Universal)."),
]
UNKNOWN = "unknown"
WORD = "[a-z0-9]+(?:[.][0-9]+)*"
#: Words from one window to the next; a window has twice as many, and no notice has more than this.
STRIDE = 40
#: Words in the pieces of a notice that serve as examples; shorter notices are used whole.
PIECES = (6, 10, 16)
#: Windows of the corpus that are examples of the unknown class, at most: one of each text with the smallest hashes.
BACKGROUND = 2000
#: n-grams that a larger share of the background holds are no features.
COMMON = 0.01
#: One background window in so many is kept out of training to set the cut-off.
FOLDS = 5
#: Share of those windows that stay below the cut-off.
CALIBRATED = 0.99
#: Share of a notice's word pairs that has to stand in the window, in order.
COVERAGE = 0.75
#: A background window with this share of a notice may be a licence and is no example of the unknown class.
DOUBT = 0.5
#: Words by which the parts of a notice may move against each other: less than the shortest notice has.
SLACK = 4
#: Weights are multiples of one over this, so that their sums do not depend on the order.
STEPS = 2**20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pairs(words: Column) -> Column:
    """A hash of each word and its successor."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def notice_table(spark: SparkSession) -> DataFrame:
    """The notices with their number and words."""
    rows = [(i, f, t) for i, (f, t) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "notice int, family string, text string").select("notice", "family", words_of(F.col("text")).alias("words"))


def notice_pairs(notices: DataFrame) -> DataFrame:
    """(notice, family, p, gram, n): the word pair at each place p of a notice of n pairs."""
    return notices.select("notice", "family", F.posexplode(pairs(F.col("words"))).alias("p", "gram"), (F.size("words") - 1).alias("n"))


def hits(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(content, at, gram): where word pairs of notices stand in ``texts`` (content, words); copies of a text count once.

    ``known`` holds the pairs of the fixed notices, so its size has a bound.
    """
    found = texts.select("content", F.posexplode(pairs(F.col("words"))).alias("at", "gram"))
    return found.join(F.broadcast(known.select("gram").distinct()), "gram", "left_semi").select("content", "at", "gram").distinct()


def features(found: DataFrame) -> DataFrame:
    """(content, w, gram): the distinct n-grams of each window, pairs and triples; a triple is two pairs in a row."""
    after = found.select("content", (F.col("at") - 1).alias("at"), F.col("gram").alias("after"))
    triples = found.join(after, ["content", "at"]).select("content", "at", F.lit(2).alias("more"), F.xxhash64("gram", "after").alias("gram"))
    both = found.select("content", "at", F.lit(1).alias("more"), "gram").unionByName(triples)
    return _in_windows(both, F.col("at") + F.col("more")).select("content", "w", "gram").distinct()


def _in_windows(rows: DataFrame, last: Column) -> DataFrame:
    """Adds w: the windows that hold the words from ``at`` to ``last`` whole; window w starts at word w * STRIDE."""
    first = F.greatest(F.floor(last / STRIDE) - 1, F.lit(0))
    return rows.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("at") / STRIDE))))


def aligned(found: DataFrame, notices: DataFrame, coverage: float) -> DataFrame:
    """(content, w, family, notice, start, end, n, share): notices of which ``coverage`` stands in the window, in order.

    ``found`` has (content, w, at, gram). A pair at place p of the notice and
    at word ``at`` of the text lies on the diagonal at - p; pairs on diagonals
    that differ by less than ``SLACK`` are counted together.
    """
    step = SLACK // 2
    base = F.floor((F.col("at") - F.col("p")) / step)
    met = found.join(F.broadcast(notice_pairs(notices)), "gram").withColumn("diagonal", F.explode(F.array(base - 1, base)))
    held = met.groupBy("content", "w", "family", "notice", "diagonal", F.col("n").alias("size")).agg(
        F.size(F.collect_set("p")).alias("n"), F.min("at").alias("start"), (F.max("at") + 2).alias("end")
    )
    share = F.col("n") / F.col("size")
    return held.withColumn("share", share).filter(share >= coverage).drop("size", "diagonal")


class Classifier:
    """Weights (gram, one column per class), intercepts, the classes and the cut-off of the unknown class."""

    def __init__(self, weights: DataFrame, intercepts: list[float], classes: list[str], cut: float):
        self.weights, self.intercepts, self.classes, self.cut = weights, intercepts, classes, cut

    def odds(self, grams: DataFrame) -> DataFrame:
        """(content, w, family, probability) for every family and every window with a known n-gram.

        The probability is that of the family against the unknown class, so that
        two licences in one window do not take it from each other.
        """
        names = [f"w{i}" for i in range(len(self.classes))]
        sums = grams.join(F.broadcast(self.weights), "gram").groupBy("content", "w").agg(
            *[(F.sum(c) + F.lit(b)).alias(c) for c, b in zip(names, self.intercepts)]
        )
        unknown = F.col(names[self.classes.index(UNKNOWN)])
        each = F.array(*[
            F.struct(F.lit(f).alias("family"), (1 / (1 + F.exp(unknown - F.col(c)))).alias("probability"))
            for c, f in zip(names, self.classes) if f != UNKNOWN
        ])
        return sums.select("content", "w", F.inline(each))

    def above(self, grams: DataFrame) -> DataFrame:
        """The rows of ``odds`` that reach the cut-off; all other windows are unknown."""
        return self.odds(grams).filter(F.col("probability") >= self.cut)


def background(docs: DataFrame, size: int) -> DataFrame:
    """(content, words): one window of each of the ``size`` texts with the smallest hashes, at a place given by the hash."""
    texts = docs.select(F.xxhash64("text").alias("content"), "text").filter("text IS NOT NULL")
    turns = texts.select("content").distinct().orderBy("content").limit(size)
    # every copy of a text gives the same window
    words = texts.join(F.broadcast(turns), "content").select("content", words_of(F.col("text")).alias("words")).filter(F.size("words") > 1)
    start = F.pmod(F.xxhash64("content"), F.greatest(F.size("words") - 2 * STRIDE, F.lit(1))).cast("int")
    return words.select("content", F.slice("words", start + 1, F.lit(2 * STRIDE)).alias("words")).groupBy("content").agg(F.first("words").alias("words"))


def train(docs: DataFrame, size: int = BACKGROUND) -> Classifier:
    """Trains on pieces of the notices and on at most ``size`` windows of ``docs`` that no notice explains."""
    spark = docs.sparkSession
    notices = notice_table(spark)
    n = F.size("words")
    pieces = [
        F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i, k=k: F.slice("words", i + 1, F.lit(k))) for k in PIECES
    ]
    known = notices.select("family", F.explode(F.concat(F.array("words"), *pieces)).alias("words")).distinct()
    known = known.select("family", F.xxhash64("family", "words").alias("content"), "words")
    sample = stored(background(docs, size))
    found = hits(sample, notice_pairs(notices)).withColumn("w", F.lit(0))
    doubtful = aligned(found, notices, DOUBT).select("content").distinct()
    sample = stored(sample.join(doubtful, "content", "left_anti").select(F.lit(UNKNOWN).alias("family"), "content", "words"))
    examples = known.unionByName(sample)
    # windows as long as the examples: each is one
    grams = (
        features(hits(examples, notice_pairs(notices))).select("content", "gram").distinct()
        .join(examples.select("content", "family"), "content")
    )
    grams = stored(grams)
    rows = sample.count()
    common = grams.filter(F.col("family") == UNKNOWN).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON * rows)
    own = grams.filter(F.col("family") != UNKNOWN).select("gram").distinct().join(common, "gram", "left_anti")
    names = sorted(str(r.gram) for r in own.collect())  # n-grams of the fixed notices
    classes = sorted({f for f, _ in NOTICES}) + [UNKNOWN]
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    held = (F.col("family") == UNKNOWN) & (F.pmod(F.xxhash64("content", F.lit("held")), F.lit(FOLDS)) == 0)
    bags = examples.select("family", "content").join(
        grams.groupBy("content").agg(F.collect_set(F.col("gram").cast("string")).alias("grams")), "content", "left"
    )
    bags = bags.withColumn("grams", F.coalesce("grams", F.array().cast("array<string>"))).withColumn("label", label.cast("double"))
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=80).fit(vectors.transform(bags.filter(~held)).select("features", "label"))
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray().tolist()
    intercepts += [-50.0] * (len(classes) - len(intercepts))  # without background the unknown class is never seen
    even = lambda x: round(float(x) * STEPS) / STEPS
    table = [(int(g), *[even(matrix[c][i]) if c < len(matrix) else 0.0 for c in range(len(classes))]) for i, g in enumerate(names)]
    weights = spark.createDataFrame(table, "gram long, " + ", ".join(f"w{i} double" for i in range(len(classes))))
    model_ = Classifier(weights, [even(b) for b in intercepts], classes, 0.5)
    # windows without a known n-gram are left to the unknown class whatever the cut-off
    aside = grams.filter(held).select("content", F.lit(0).alias("w"), "gram")
    best = model_.odds(aside).groupBy("content").agg(F.max("probability").alias("best"))
    limit = best.agg(F.percentile("best", CALIBRATED)).first()[0]
    model_.cut = max(0.5, limit or 0.0)
    return model_


def scan(docs: DataFrame, size: int = BACKGROUND) -> DataFrame:
    """Licence notices in every row of ``docs`` (doc_id, text).

    Returns doc_id, n_paragraphs (lines with a word), n_licence (confirmed
    notices), families (theirs, sorted), probability (of the surest, NULL without
    any) and notices (family, first and last word from 0, share of the notice that
    stands there), in the order of the text. Words are ASCII letters and digits in
    lower case; line ends and other characters between them do not matter. Of
    notices that overlap, the one with more word pairs (then the larger share,
    then the first in the list) holds a word; a notice counts if it holds more
    than half of its words. NULL and wordless texts have no paragraphs. Rows of
    equal text get equal results; NULL ids stay. An empty table gives an empty
    result; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    classifier = train(docs, size)
    notices = notice_table(docs.sparkSession)
    texts = docs.select(F.xxhash64("text").alias("content"), words_of(F.col("text")).alias("words"))
    found = stored(hits(texts, notice_pairs(notices)))
    likely = stored(classifier.above(features(found)))
    windows = _in_windows(found, F.col("at") + 1).join(likely.select("content", "w").distinct(), ["content", "w"])
    named = (
        aligned(windows, notices, COVERAGE).join(likely, ["content", "w", "family"])
        .groupBy("content", "family", "notice", "start", "end").agg(F.max("n").alias("n"), F.max("share").alias("share"), F.max("probability").alias("probability"))
    )
    one = F.struct("n", "share", (-F.col("notice")).alias("first"), "start", "end", "family", "probability")
    held = named.select("content", F.explode(F.sequence("start", F.col("end") - 1)).alias("at"), one.alias("one"))
    held = held.groupBy("content", "at").agg(F.max("one").alias("one"))
    winners = held.groupBy("content", "one").agg(F.count(F.lit(1)).alias("words")).filter("2 * words > one.end - one.start")
    place = F.struct(
        F.col("one.start").alias("first_word"), (F.col("one.end") - 1).alias("last_word"), F.col("one.family").alias("family"), F.col("one.share").alias("share")
    )
    per_text = winners.groupBy("content").agg(
        F.count(F.lit(1)).alias("n_licence"), F.array_sort(F.collect_set("one.family")).alias("families"),
        F.max("one.probability").alias("probability"), F.array_sort(F.collect_list(place)).alias("notices"),
    )
    lines = F.filter(F.split("text", "\\n"), lambda line: line.rlike("[A-Za-z0-9]"))
    out = docs.select("doc_id", F.xxhash64("text").alias("content"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_paragraphs"))
    empty = F.array().cast(per_text.schema["notices"].dataType)
    return out.join(per_text, "content", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability", F.coalesce("notices", empty).alias("notices"),
    )
