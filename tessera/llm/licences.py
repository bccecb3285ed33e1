"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file that mentions licensing is cut into units: its whole text, its header (the comment lines it begins
with), its paragraphs and its lines that mention licensing. Distinct units become sparse vectors of their
words, weighted by how rare a word is among all units and templates, and are compared with each template
by joining words. A file whose whole text is like a template, or that is named like a licence file and
holds a statement, speaks for its directory; files without a statement take the licence of the nearest
directory above them that has one, by an equality join of directory paths. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.licence_texts import TEMPLATES

#: A text that states a licence holds one of these in lower case, as every template does.
ANCHORS = ("licens", "licenc", "copyright", "spdx", "redistribut", "permission", "public domain", "creative commons", "cc by")
#: A line of a header: blank, or a comment in one of the usual notations.
HEADER_LINE = r"^\s*($|#|//|/\*|\*|--|;|%|<!--)"
#: Between two paragraphs; between two words; names of licence files.
PARAGRAPH, BETWEEN, FILE_NAME = "\\n[ \\t\\r]*\\n", "[^\\p{L}\\p{N}]+", "(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
#: Least cosine of a unit that names a licence.
LIKE = 0.7


def _mentions(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(a)) for a in ANCHORS])


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda t: t != "")


def _vectors(named: DataFrame, *key: str) -> DataFrame:
    return named.select(*key, F.explode(_terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def units(files: DataFrame) -> DataFrame:
    """(file_id, path, whole, text) of the units of ``files`` (file_id, path, text) that mention licensing."""
    text = F.col("text")
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda x: ~x.rlike(HEADER_LINE)), True).cast("int")
    header = F.array_join(F.slice(lines, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(lines))), "\n")
    parts = F.filter(F.array_union(F.array(header), F.array_union(F.split(text, PARAGRAPH), lines)), lambda x: _mentions(x))
    both = F.concat(F.array(F.struct(F.lit(True).alias("whole"), text.alias("text"))), F.transform(parts, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text"))))
    return files.where(_mentions(text)).select("file_id", "path", F.explode(both).alias("u")).select("file_id", "path", "u.whole", "u.text")


def match(texts: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, like: float = LIKE) -> DataFrame:
    """(key, licence, cosine) of those of ``texts`` (key, text; distinct) whose best template is at least ``like`` alike."""
    spark = texts.sparkSession
    known = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, licence string, text string")
    a = cut(_vectors(texts, "key"))  # read three times
    b = _vectors(known, "template", "licence")
    df = a.select("term").union(b.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = a.select("key").distinct().count() + len(templates)
    rare = df.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    a, b = (v.join(rare, "term").withColumn("w", F.col("tf") * F.col("idf")) for v in (a, b))
    length = lambda v, key: v.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"{key}_length"))
    dot = a.select("key", "term", "w").join(b.select("template", "licence", "term", F.col("w").alias("v")), "term")
    dots = dot.groupBy("key", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    both = dots.join(length(a, "key"), "key").join(length(b, "template"), "template")
    cosine = F.round(F.col("dot") / (F.col("key_length") * F.col("template_length")), 6)
    scored = both.select("key", "licence", cosine.alias("cosine")).where(F.col("cosine") >= like)
    return scored.groupBy("key").agg(_best()).select("key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def _best() -> Column:
    """The most alike of a group, ties by name."""
    return F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")


def directory(path: Column) -> Column:
    """The part of a path before its last slash, empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def scan(files: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, like: float = LIKE) -> DataFrame:
    """(file_id, path, licence, cosine, origin, directory) of every row of ``files`` (file_id, path, text).

    origin: "statement" for the text's own licence (its most alike unit, ties by name), "inherited" for
    that of the nearest directory with a licence file, whose path is given, or "none". The top of all
    paths is the directory "". A null or empty text states nothing; a text of any length is compared
    whole. A null path has no directory. In a directory with several licence files the most alike counts,
    ties by name. Repeated rows each give a row; those with the same id and path share the most alike
    statement of their texts. Other columns are not read. An empty table gives no rows.
    """
    some = files.select("file_id", "path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = cut(units(some).withColumn("key", F.unhex(F.md5("text"))))  # only of files that mention licensing
    found = match(each.groupBy("key").agg(F.first("text").alias("text")), templates, like=like)
    speaks = F.max(F.col("whole")) | F.coalesce(F.first("path").rlike(FILE_NAME), F.lit(False))
    own = cut(
        each.select("file_id", "path", "whole", "key").join(found, "key").groupBy("file_id", "path").agg(_best(), speaks.alias("is_file"))
        .select("file_id", "path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), "is_file")
    )
    speaking = own.where("is_file").select(directory(F.col("path")).alias("dir"), "licence", "cosine").where("dir IS NOT NULL")
    licensed = speaking.groupBy("dir").agg(_best())
    # Every directory of the table and those above it, once.
    dirs = files.select(directory(F.col("path")).alias("of")).distinct().where("of IS NOT NULL")
    parts = F.split("of", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))
    nearest = (
        dirs.select("of", F.explode(above).alias("a")).select("of", "a.*").join(licensed, "dir").groupBy("of").agg(F.max_by(F.struct("dir", "b"), "depth").alias("n"))
        .select("of", F.col("n.dir").alias("directory"), F.col("n.b.licence").alias("its"), (-F.col("n.b.c")).alias("its_cosine"))
    )
    all_ = files.select("file_id", "path", directory(F.col("path")).alias("of"))
    mine = own.select(F.col("file_id").alias("_id"), F.col("path").alias("_path"), "licence", "cosine")
    joined = all_.join(mine, F.col("file_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left").join(nearest, "of", "left")
    has, gets = F.col("licence").isNotNull(), F.col("its").isNotNull()
    return joined.select(
        "file_id",
        "path",
        F.coalesce("licence", "its").alias("licence"),
        F.when(has, F.col("cosine")).otherwise(F.col("its_cosine")).alias("cosine"),
        F.when(has, F.lit("statement")).when(gets, F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(~has, F.col("directory")).alias("directory"),
    )
