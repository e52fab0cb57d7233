"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from directories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorium.llm.base import Scratch, pick
from sensorium.llm.notices import Notices
from sensorium.session import small_rows

#: One typical notice of each licence.
TEMPLATES = {
    "AGPL-3.0": "This program is free software under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal license.",
    "EPL-2.0": "Made available under the terms of the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense license.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence is a header if it has one of these.
HEADER = "licen[sc]e|copyright|spdx"
LICENCE_FILE = r"(^|/)(licen[sc]e|copying|notice|unlicense)([-._][^/]*)?$"


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def headers_of(text: Column) -> Column:
    """The sentences and lines of a text that may hold a licence notice, lower-cased."""
    lines = F.split(F.regexp_replace(lower(F.coalesce(text, F.lit(""))), r"([.!?])[ \t\r\n]+", "$1\n"), "\n")
    return F.array_distinct(F.filter(lines, lambda x: x.rlike(HEADER)))


def scores(headers: DataFrame, templates: Mapping[str, str], least: float) -> DataFrame:
    """``header, licence, score`` of distinct headers: the nearest template from ``least`` on.

    Weights are ``tf (ln((1 + N) / (1 + df)) + 1)``, with N and df over all distinct headers and
    the templates. Equal scores, to nine decimals, go to the smaller name.
    """
    spark = headers.sparkSession
    scratch = Scratch(spark)
    known = spark.createDataFrame(sorted(templates.items()), "licence string, header string").withColumn("header", lower(F.col("header")))
    all_ = headers.select("header", F.lit(None).cast("string").alias("licence")).union(known.select("header", "licence"))
    terms = scratch.keep(_terms(all_))
    total = all_.count()
    df = terms.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1.0)
    weighed = terms.join(scratch.keep(df), "token").withColumn("w", F.col("tf") * F.col("idf"))
    sides = scratch.keep(weighed.select("header", "licence", "token", "w"))
    ours = sides.filter("licence is null").select("header", "token", "w")
    theirs = sides.filter("licence is not null").select("licence", "token", F.col("w").alias("v"))
    theirs = F.broadcast(theirs) if sum(len(t) for t in templates.values()) <= small_rows(spark) else theirs
    norm = ours.groupBy("header").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    norms = sides.filter("licence is not null").groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    norms = F.broadcast(norms) if len(templates) <= small_rows(spark) else norms
    dots = ours.join(theirs, "token").groupBy("header", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9)
    near = dots.join(norm, "header").join(norms, "licence").select("header", "licence", cosine.alias("score")).filter(F.col("score") >= least)
    best = near.groupBy("header").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("header", "b.licence", (-F.col("b.s")).alias("score"))


def _terms(all_: DataFrame) -> DataFrame:
    tokens = all_.select("header", "licence", F.explode(F.regexp_extract_all("header", F.lit("([a-z0-9]+)"))).alias("token"))
    return tokens.groupBy("header", "licence", "token").agg(F.count("*").alias("tf"))


def spdx(text: Column, known: Notices) -> Column:
    """The first SPDX line's licence that is known, or null."""
    names = F.create_map(*[F.lit(x) for pair in sorted(known.names.items()) for x in pair])
    said = F.regexp_extract_all(F.lower(text), F.lit(r"spdx-license-identifier:[\s(]*([a-z0-9.+-]+)"), 1)
    plain = F.transform(said, lambda n: F.try_element_at(names, F.regexp_replace(n, r"(?:-only|-or-later|\+)$", "")))
    return F.get(F.filter(plain, lambda n: n.isNotNull()), 0)


def pieces_of(rows: DataFrame) -> DataFrame:
    """``row, piece`` of ``row, text, whole``: what of a text may be a notice.

    Runs of comment or plain lines with a header word, their paragraphs, sentences and lines; of licence files
    (``whole``) the text too. Lines that only name the holders are left out. Windows and groups hold one text.
    """
    comment = r"^\s*(?:#+|//+!?|/\*+!?|\*+/?|--+|;+|%+|<!--|\"\"\"|''')\s?"
    head = rf"{HEADER}|public domain"
    low = F.lower("text")
    lines = rows.select("row", F.posexplode(F.split(low, "\n")).alias("pos", "line"))
    marked = F.col("line").rlike(comment)
    # sums over windows number the runs (a blank line or another kind ends one) and the paragraphs
    order = Window.partitionBy("row").orderBy("pos")
    lines = lines.withColumn("kind", F.when(marked, "comment").when(F.col("line").rlike(r"\S"), "plain"))
    lines = lines.withColumn("line", F.when(marked, F.regexp_replace("line", comment, "")).otherwise(F.col("line")))
    new = F.col("kind").isNull() | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    lines = lines.withColumns({"new": new.cast("int"), "blank": (~F.col("line").rlike(r"\S")).cast("int"), "head": F.col("line").rlike(head)})
    lines = lines.withColumns({"run": F.sum("new").over(order), "para": F.sum("blank").over(order)})
    held = F.max("head").over(Window.partitionBy("row", "run"))
    lines = lines.withColumn("held", held).where(r"held AND blank = 0 AND NOT line RLIKE '^\\W*(?:copyright\\b|\\(c\\)|all rights reserved|portions copyright)'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("piece")
    runs = lines.groupBy("row", "run").agg(joined).select("row", "piece")
    paras = lines.groupBy("row", "run", "para").agg(joined).where(F.col("piece").rlike(head))
    sentences = paras.select("row", F.explode(F.split("piece", r"(?<=[.!?:;])\s+")).alias("piece")).where(F.col("piece").rlike(head))
    every = runs.union(paras.select("row", "piece")).union(sentences).union(lines.where("head").select("row", "line"))
    return every.union(rows.where("whole").select("row", low.alias("piece"))).distinct()


def noticed(rows: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """``row, licence, score`` of ``row, text, whole``: the SPDX line, else the piece nearest to a template of ``Notices``.

    Weights come from the templates alone, a stated list that is small enough to be sent to every task.
    """
    spark, known = rows.sparkSession, Notices()
    named = rows.select("row", spdx(F.col("text"), known).alias("licence"), F.lit(1.0).alias("score")).where("licence IS NOT NULL")
    pieces = scratch.keep(pieces_of(rows.join(named.select("row"), "row", "left_anti")))
    apart = scratch.keep(pieces.select("piece").distinct().withColumn("id", F.monotonically_increasing_id()))
    terms = apart.select("id", F.explode(F.regexp_extract_all("piece", F.lit("([a-z0-9]+)"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    idf = F.broadcast(spark.createDataFrame(sorted(known.idf.items()), "token string, idf double"))
    weighed = scratch.keep(terms.join(idf, "token", "left").select("id", "token", (F.col("tf") * F.coalesce("idf", F.lit(known.rare))).alias("w")))
    listed = [(k, name, token, w) for k, (name, vector) in enumerate(known.vectors) for token, w in sorted(vector.items())]
    templates = F.broadcast(spark.createDataFrame(listed, "no int, licence string, token string, v double"))
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(templates, "token").groupBy("id", "no", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 9)
    near = dots.join(norm, "id").select("id", "licence", score.alias("score")).where(F.col("score") >= least)
    near = near.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).join(apart, "id").join(pieces, "piece")
    best = near.groupBy("row").agg(F.min("b").alias("b")).select("row", "b.licence", (-F.col("b.s")).alias("score"))
    return scratch.keep(named.union(best))


def scan(
    files: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    least: float = 0.75,
    id_column: str = "path",
    path_column: str = "path",
    text_column: str = "text",
    least_notice: float | None = 0.8,
) -> DataFrame:
    """``id, path, licence, score, origin`` of every file.

    A file has the licence of its best header (``origin`` "header"): of its sentences against
    ``templates``, or of its SPDX line, runs of lines and, if it is a licence file, its whole text
    against those of ``Notices``, from ``least_notice`` on (None: not compared); equal scores
    go to the sentences. Otherwise it inherits that of
    the licence file in the nearest directory above it ("inherited"), of which the best score and
    then the smallest path counts. Otherwise the licence is null ("none"). Licence files
    are those called LICENSE, LICENCE, COPYING, NOTICE or UNLICENSE, with any ending. Null and
    empty texts have no header; null paths lie in no directory. Rows are neither dropped nor
    repeated. Each distinct header and directory is treated once, however many files have it.
    """
    spark = files.sparkSession
    scratch = Scratch(spark)
    rows = pick(files, id=id_column, path=path_column, text=text_column)
    whole = F.coalesce(lower(F.col("path")).rlike(LICENCE_FILE), F.lit(False))
    # only texts that may hold a notice are kept for comparing
    may = F.when(whole | lower(F.col("text")).rlike(f"{HEADER}|public domain"), F.col("text"))
    rows = rows.select("id", "path", headers_of(F.col("text")).alias("headers"), may.alias("text"), whole.alias("whole"))
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    held = rows.filter(F.size("headers") > 0).select("row", F.explode("headers").alias("header"))
    nearest = scratch.keep(scores(held.select("header").distinct(), templates, least))
    own = held.join(nearest, "header").groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    own = own.select("row", "b.licence", (-F.col("b.s")).alias("score"), F.lit(0).alias("kind"))
    if least_notice is not None:
        found = noticed(rows.where("text IS NOT NULL").select("row", "text", "whole"), scratch, least_notice)
        own = own.union(found.select("row", "licence", "score", F.lit(1)))
    own = own.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind", "licence")).alias("b"))
    own = scratch.keep(own.select("row", "b.licence", (-F.col("b.s")).alias("score")))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("")).alias("folder")
    given = rows.join(own, "row").filter(lower(F.col("path")).rlike(LICENCE_FILE)).select(folder, "path", "licence", "score")
    given = given.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("b"))
    given = scratch.keep(given.select(F.col("folder").alias("above"), F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score")))
    folders = rows.filter("path is not null").select(folder).distinct()
    parts = F.split("folder", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = folders.select("folder", F.explode(F.array_distinct(steps)).alias("above"))
    passed = above.join(given, "above").groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "licence", "score")).alias("b"))
    passed = scratch.keep(passed.select("folder", F.col("b.licence").alias("above_licence"), F.col("b.score").alias("above_score")))
    out = rows.select("row", "id", "path", folder).join(own, "row", "left").join(passed, "folder", "left")
    origin = F.when(F.col("licence").isNotNull(), "header").when(F.col("path").isNotNull() & F.col("above_licence").isNotNull(), "inherited").otherwise("none")
    got = F.when(origin == "inherited", F.col("above_licence")).otherwise(F.col("licence"))
    score = F.when(origin == "inherited", F.col("above_score")).otherwise(F.col("score"))
    return out.select("id", "path", got.alias("licence"), score.alias("score"), origin.alias("origin"))
