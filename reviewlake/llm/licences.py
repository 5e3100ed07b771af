"""Licence scans: sparse TF-IDF cosine of licence lines and files to templates, then directory inheritance.

Every line of a file that holds a trigger word, and every licence file as a whole, is a unit.
A unit's terms meet the templates' in one join on the term; units without common terms cost
nothing more.  A file without a licence of its own takes that of the nearest directory above it
in which a licence file declares one; this is resolved once per directory, not per file.
DataFrame expressions only; templates are parameters, everything else is joined without hints.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import word_array
from .tables import written

#: fixed values: header notices by licence
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
TRIGGER = "(?i)licen[cs]e|copyright|released under|spdx"
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice)"
LEAST_COSINE = 0.6


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _ancestors(d: Column) -> Column:
    """A directory and those above it, the root as the empty text, each with its depth."""
    parts = F.split(d, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth")))


def licence_matches(files: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COSINE,
                    every_term: bool = True) -> DataFrame:
    """(path, licence, cosine): the best template of each file that has one, ties to the smaller name.

    Term weights are (1 + ln tf) * idf with idf = ln((1 + N) / (1 + df)) + 1, df counted over all
    files for every term of a unit.  Without ``every_term`` terms of no template have the idf of a
    term that no file holds; ordinary words beside a notice then weigh the more, the more files there are.
    """
    spark = files.sparkSession
    names = spark.createDataFrame([(str(k), str(v)) for k, v in templates.items()], "licence string, notice string")
    tpl = names.select("licence", F.explode(word_array(F.col("notice"))).alias("term")).groupBy("licence", "term").count()
    words = word_array(F.col("text"))
    n_files = files.count()
    rare = F.log(F.lit(1.0 + n_files)) + 1
    name = F.regexp_extract("path", "[^/]*$", 0)
    units = files.where(F.col("text").rlike(TRIGGER)).select("path", F.posexplode(F.concat(
        F.split("text", "\n"), F.when(name.rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>")))).alias("unit", "line"))
    units = units.where(F.col("line").rlike(TRIGGER)).select("path", "unit", F.explode(word_array(F.col("line"))).alias("term"))
    units = written(units.groupBy("path", "unit", "term").count(), "licence-units")
    if every_term:
        wanted = tpl.select("term").unionAll(units.select("term")).distinct()
        df = files.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi")
    else:
        known = sorted({r["term"] for r in tpl.select("term").distinct().collect()})
        df = files.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, known)).cast("array<string>"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = written(df, "licence-terms")
    idf = F.coalesce(F.log((1.0 + n_files) / (1 + F.col("df"))) + 1, rare)
    tpl = tpl.join(df, "term", "left").select("licence", "term", ((1 + F.log("count")) * idf).alias("w"))
    norms = tpl.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tpl = tpl.join(norms, "licence").select("licence", F.col("term").alias("t_term"), (F.col("w") / F.col("norm")).alias("t_w"))
    tf = units.join(df, "term", "left").select("path", "unit", "term", ((1 + F.log("count")) * idf).alias("w"))
    size = tf.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(tpl, F.col("term") == F.col("t_term")).groupBy("path", "unit", "licence").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    cosine = dots.join(size, ["path", "unit"]).select("path", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= least)
    return cosine.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")).select(
        "path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def scan_licences(files: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COSINE,
                  every_term: bool = True) -> DataFrame:
    """One row per row of ``files`` (path, text): path, licence, cosine, origin, declared_in.

    ``origin`` is ``own`` (a line or the file itself matches), ``inherited`` (the nearest
    directory at or above the file's in which a licence file has a match; of several files the
    best match, ties to the smaller licence) or ``none``.  ``declared_in`` is that directory.

    Null and empty texts have no licence of their own.  A null path inherits nothing and has
    none.  Repeated rows are returned each; rows repeating a path with another text are one file
    with the best match of all.  An empty table gives an empty table.
    """
    files = files.select("path", F.col("text").cast("string").alias("text"))
    own = written(licence_matches(files.where("path IS NOT NULL AND text IS NOT NULL"), templates, least, every_term), "licences")
    name = F.regexp_extract("path", "[^/]*$", 0)
    declared = (own.where(name.rlike(LICENCE_FILE)).groupBy(directory(F.col("path")).alias("dir"))
                .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("d"))
                .select("dir", F.col("d.licence").alias("d_licence"), (-F.col("d.c")).alias("d_cosine")))
    dirs = files.where("path IS NOT NULL").select(directory(F.col("path")).alias("of")).distinct()
    up = dirs.select("of", F.explode(_ancestors(F.col("of"))).alias("a")).select("of", "a.dir", "a.depth")
    nearest = written(up.join(declared, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "d_licence", "d_cosine")).alias("n")), "nearest")
    own = own.select(F.col("path").alias("o_path"), F.col("licence").alias("o_licence"), F.col("cosine").alias("o_cosine"))
    out = files.select("path").join(own, F.col("path") == F.col("o_path"), "left").withColumn("dir", directory(F.col("path")))
    out = out.join(nearest, F.col("dir") == F.col("of"), "left")
    mine = F.col("o_licence").isNotNull()
    return out.select("path", F.coalesce("o_licence", "n.d_licence").alias("licence"), F.coalesce("o_cosine", "n.d_cosine").alias("cosine"),
                      F.when(mine, "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"),
                      F.when(~mine, F.col("n.dir")).alias("declared_in"))
