"""Path templates: which curated pattern, such as /units/{id}, an observed path belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACEHOLDER = r"^\{[A-Za-z_][A-Za-z0-9_]*\}$"


def templates(patterns: DataFrame) -> DataFrame:
    """(pattern, regex, segments, literals) of each distinct ``pattern``."""
    parts = F.split("pattern", "/")
    literal = F.size(F.filter(parts, lambda s: ~s.rlike(PLACEHOLDER)))
    part = lambda s: F.when(s.rlike(PLACEHOLDER), F.lit("[^/]+")).otherwise(F.concat(F.lit(r"\Q"), s, F.lit(r"\E")))
    regex = F.concat(F.lit("^"), F.array_join(F.transform(parts, part), "/"), F.lit("$"))
    return patterns.select("pattern").distinct().select("pattern", regex.alias("regex"), F.size(parts).alias("segments"), literal.alias("literals"))


def match(paths: DataFrame, known: DataFrame) -> DataFrame:
    """(path, pattern, status) of each distinct path: exact, template, ambiguous, or unknown.

    A pattern equal to the path wins; else the templates with as many segments that match, the one with most
    literals. Two of those are ambiguous. A template is found by its number of segments and its first literal: a path
    is looked up once for each position in which templates of its length have theirs, so it meets templates that agree
    with it there and no others. Templates of placeholders alone meet the paths of their length.
    """
    parts = F.split("pattern", "/")
    # Segment 1 of a path that begins with a slash is empty; the literal that tells templates apart comes after it.
    literals = F.filter(F.sequence(F.lit(2), F.size(parts)), lambda k: ~F.element_at(parts, k).rlike(PLACEHOLDER))
    place = F.when(F.size(parts) > 1, F.try_element_at(literals, F.lit(1)))
    keyed = templates(known).withColumn("place", F.coalesce(place, F.lit(0)))
    keyed = keyed.withColumn("head", F.when(F.col("place") > 0, F.try_element_at(F.split("pattern", "/"), F.col("place"))).otherwise(F.lit("")))
    places = keyed.select("segments", "place").distinct()  # at most one for each two numbers of segments
    distinct = paths.select("path").distinct().withColumn("segments", F.size(F.split("path", "/")))
    own = distinct.join(places, "segments").withColumn("head", F.when(F.col("place") > 0, F.try_element_at(F.split("path", "/"), F.col("place"))).otherwise(F.lit("")))
    met = own.join(keyed, ["segments", "place", "head"])
    hits = met.where((F.col("path") == F.col("pattern")) | F.expr("path RLIKE regex")).select("path", "pattern", (F.col("path") == F.col("pattern")).alias("exact"), "literals").distinct()
    rank = F.rank().over(Window.partitionBy("path").orderBy(F.desc("exact"), F.desc("literals")))
    best = hits.withColumn("_r", rank).where("_r = 1").groupBy("path").agg(F.min("pattern").alias("pattern"), F.count("*").alias("n"), F.bool_or("exact").alias("exact"))
    status = F.when(F.col("n") > 1, F.lit("ambiguous")).when(F.col("exact"), F.lit("exact")).when(F.col("n") == 1, F.lit("template")).otherwise(F.lit("unknown"))
    joined = distinct.select("path").join(best, "path", "left")
    return joined.select("path", F.when(F.col("n") == 1, F.col("pattern")).alias("pattern"), status.alias("status"))


def canonical(path: Column, pattern: Column) -> Column:
    return F.coalesce(pattern, path)
