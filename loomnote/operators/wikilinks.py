"""Wikilinks: parsing, resolution to notes, edges, broken links and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.functions.text import basename, wikilinks, without_extension


def parsed_links(notes: DataFrame) -> DataFrame:
    """``notebook_id, source, ordinal, target, display_text, start, end`` of every link with a target."""
    return notes.select("notebook_id", F.col("relative_path").alias("source"), F.explode(wikilinks(F.coalesce("content", F.lit("")))).alias("x")).select("notebook_id", "source", "x.*")


def _posix(path):
    return F.replace(path, F.lit("\\"), F.lit("/"))


def resolved_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links`` with ``resolved``: the note's path, or null.

    A target with a slash names a path, otherwise a name; case and a final ``.md`` don't matter. Several notes of a
    name: the shortest path, then the least. What a name leads to is decided once per name, so the join cannot grow.
    """
    best = F.min(F.struct(F.length("relative_path").alias("n"), F.col("relative_path").alias("p")))["p"].alias("hit")
    by_path = notes.groupBy("notebook_id", F.lower(without_extension(_posix(F.col("relative_path")))).alias("key")).agg(best).withColumn("whole", F.lit(True))
    by_name = notes.groupBy("notebook_id", F.lower(basename(F.col("relative_path"))).alias("key")).agg(best).withColumn("whole", F.lit(False))
    known = by_path.unionByName(by_name).withColumnRenamed("hit", "resolved")
    bare = without_extension(F.col("target"))
    keyed = links.withColumn("key", F.lower(_posix(bare))).withColumn("whole", F.contains(_posix(bare), F.lit("/")))
    found = keyed.join(known, ["notebook_id", "key", "whole"], "left")
    return found.select(*links.columns, F.when(F.col("key") == "", F.lit(None)).otherwise(F.col("resolved")).alias("resolved"))


def resolved_spans(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``source, ordinal, start, end, target, display_text, resolved`` of every link: what an editor underlines, opens or offers to create."""
    return resolved_links(links, notes).select("source", "ordinal", "start", "end", "target", "display_text", "resolved")


def explicit_edges(links: DataFrame, notes: DataFrame, target: str | None = None) -> DataFrame:
    """One edge per (source, note linked to), from the first such link; links to itself and unresolved ones give none."""
    hits = resolved_links(links, notes).where("resolved is not null and resolved <> source")
    hits = hits if target is None else hits.where(F.col("resolved") == target)
    first = hits.groupBy("notebook_id", "source", F.col("resolved").alias("target")).agg(F.min_by(F.struct(F.lower(basename(F.col("resolved"))).alias("noun"), "display_text"), F.col("ordinal")).alias("x"))
    return first.select("notebook_id", "source", "target", F.lit("explicit").alias("type"), "x.noun", "x.display_text", F.lit(100).alias("count"))


def broken_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """The links that lead to no note."""
    return resolved_links(links, notes).where("resolved is null").drop("resolved")


def repoint_suggestions(broken: DataFrame, notes: DataFrame, most: int = 3) -> DataFrame:
    """For each broken target up to ``most`` notes whose name contains it, or that contains their name; by path.

    Names are compared once each: distinct targets with distinct names, by letters: a target and a name can only
    contain one another if the shorter's first three letters occur in the longer, which makes it an equi-join.
    """
    targets = broken.select("notebook_id", "target", F.lower(basename(F.col("target"))).alias("wanted")).where("wanted <> ''").distinct()
    names = notes.select("notebook_id", "relative_path", F.lower(basename(F.col("relative_path"))).alias("name")).where("name <> ''")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    head = lambda c: F.array(F.substring(c, 1, 3))
    one = targets.withColumn("gram", F.explode(grams(F.col("wanted")))).join(names.withColumn("gram", F.explode(head(F.col("name")))), ["notebook_id", "gram"]).where(F.contains("wanted", "name"))
    two = targets.withColumn("gram", F.explode(head(F.col("wanted")))).join(names.withColumn("gram", F.explode(grams(F.col("name")))), ["notebook_id", "gram"]).where(F.contains("name", "wanted"))
    # Strings of under three letters have no gram of three: they are few, and meet by position of any letter run.
    short_names, short_targets = names.where("length(name) < 3"), targets.where("length(wanted) < 3")
    cols = ["notebook_id", "target", "relative_path"]
    runs = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(F.substring(c, i, F.lit(1)), F.substring(c, i, F.lit(2))))))
    three = targets.withColumn("gram", F.explode(runs(F.col("wanted")))).join(short_names.withColumnRenamed("name", "gram"), ["notebook_id", "gram"])
    four = short_targets.withColumn("gram", F.col("wanted")).join(names.withColumn("gram", F.explode(runs(F.col("name")))), ["notebook_id", "gram"])
    hits = one.select(cols).union(two.select(cols)).union(three.select(cols)).union(four.select(cols)).distinct()
    rank = F.row_number().over(Window.partitionBy("notebook_id", "target").orderBy("relative_path"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most)


def completions(notes: DataFrame, current: str | None = None) -> DataFrame:
    """What to write to link to each note: its name, or its path without ``.md`` where the name is ambiguous; in list order."""
    name = basename(F.col("relative_path"))
    ambiguous = F.count("*").over(Window.partitionBy("notebook_id", F.lower(name))) > 1
    out = notes.select("notebook_id", "relative_path", F.when(ambiguous, without_extension(_posix(F.col("relative_path")))).otherwise(name).alias("completion"))
    depth = F.size(F.split(_posix(F.col("relative_path")), "/")) - 1
    out = out.withColumn("sort_text", F.concat(F.lpad(depth.cast("string"), 3, "0"), F.col("completion")))
    return out if current is None else out.where(F.col("relative_path") != current)
