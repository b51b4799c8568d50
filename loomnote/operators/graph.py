"""The link graph: an edge table (notebook_id, source, target, type, noun, display_text, count), unique by type, source and target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomnote.functions.text import link_title, search_title

EDGE_TYPES = ("explicit", "mention", "similar")
EDGE_COLUMNS = ["notebook_id", "source", "target", "type", "noun", "display_text", "count"]
EDGE_KEY = ["notebook_id", "type", "source", "target"]
EDGE_SCHEMA = "notebook_id string, source string, target string, type string, noun string, display_text string, count int"


def union_edges(*edges: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (e.select(EDGE_COLUMNS) for e in edges))


def known_types(edges: DataFrame) -> DataFrame:
    """Without edges of a type that this engine does not know."""
    return edges.where(F.col("type").isin(*EDGE_TYPES))


def upserted(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` edges put in; one with the same key replaces the old."""
    return union_edges(edges.join(new.select(EDGE_KEY).distinct(), EDGE_KEY, "left_anti"), new)


def _replaced(edges: DataFrame, gone: DataFrame, keys: list[str], new: DataFrame) -> DataFrame:
    return upserted(edges.join(gone.select(keys).distinct(), keys, "left_anti"), new)


def replace_outbound(edges: DataFrame, notes: DataFrame, type_: str, new: DataFrame) -> DataFrame:
    """The edges of a type from ``notes`` (notebook_id, relative_path) replaced by ``new``."""
    return _replaced(edges, _ends(notes, "source", type_), ["notebook_id", "source", "type"], new)


def replace_inbound(edges: DataFrame, notes: DataFrame, type_: str, new: DataFrame) -> DataFrame:
    return _replaced(edges, _ends(notes, "target", type_), ["notebook_id", "target", "type"], new)


def replace_symmetric(edges: DataFrame, notes: DataFrame, type_: str, new: DataFrame) -> DataFrame:
    without = edges.join(_ends(notes, "source", type_), ["notebook_id", "source", "type"], "left_anti")
    return _replaced(without, _ends(notes, "target", type_), ["notebook_id", "target", "type"], new)


def replace_type(edges: DataFrame, type_: str, new: DataFrame) -> DataFrame:
    return union_edges(edges.where(F.col("type") != type_), new)


def remove_notes(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Without the edges that touch any of ``notes``."""
    gone = notes.select("notebook_id", "relative_path").distinct()
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("relative_path", end), ["notebook_id", end], "left_anti")
    return edges.select(EDGE_COLUMNS)


def _ends(notes: DataFrame, end: str, type_: str) -> DataFrame:
    return notes.select("notebook_id", F.col("relative_path").alias(end), F.lit(type_).alias("type")).distinct()


def _linking(edges: DataFrame) -> DataFrame:
    """Explicit links and mentions: what counts for degree and orphans."""
    return edges.where(F.col("type") != "similar")


def touching(edges: DataFrame) -> DataFrame:
    """Each end of each edge, as ``relative_path``."""
    return edges.select("notebook_id", F.explode(F.array("source", "target")).alias("relative_path"))


def orphans(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes that no explicit link and no mention touches."""
    return notes.select("notebook_id", "relative_path").join(touching(_linking(edges)).distinct(), ["notebook_id", "relative_path"], "left_anti")


def degrees(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Explicit links and mentions in and out of each note."""
    n = touching(_linking(edges)).groupBy("notebook_id", "relative_path").agg(F.count("*").alias("degree"))
    return notes.select("notebook_id", "relative_path").join(n, ["notebook_id", "relative_path"], "left").select("notebook_id", "relative_path", F.coalesce("degree", F.lit(0)).alias("degree"))


def inbound_counts(edges: DataFrame) -> DataFrame:
    """Edges of every type into each note that has any."""
    return edges.groupBy("notebook_id", F.col("target").alias("relative_path")).agg(F.count("*").alias("inbound"))


def links_of(notes: DataFrame, edges: DataFrame, notebook_id: str, path: str) -> DataFrame:
    """The five lists of a note's links: ``bucket, note_path, note_title, type, noun, display_text, count, rank``.

    Explicit links go by title, mentions and similar notes by count; ties by path. Similar notes come from outbound
    edges alone, as they are stored both ways.
    """
    mine = edges.where(F.col("notebook_id") == notebook_id)
    out, into = F.col("source") == path, F.col("target") == path
    cases = [(out & (F.col("type") == "explicit"), "explicit_out", "target"), (into & (F.col("type") == "explicit"), "explicit_in", "source"), (out & (F.col("type") == "mention"), "mention_out", "target"), (into & (F.col("type") == "mention"), "mention_in", "source"), (out & (F.col("type") == "similar"), "similar", "target")]
    rows = [F.when(test, F.struct(F.lit(bucket).alias("bucket"), F.col(end).alias("note_path"))) for test, bucket, end in cases]
    seen = mine.where(out | into).select("*", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*", link_title(F.col("x.note_path")).alias("note_title"), "type", "noun", "display_text", "count")
    by = F.when(F.col("type") == "explicit", F.lit(0)).otherwise(-F.col("count"))
    order = Window.partitionBy("bucket").orderBy(by, F.when(F.col("type") == "explicit", F.col("note_title")), "note_path")
    return seen.withColumn("rank", F.row_number().over(order))


def capped_nodes(notes: DataFrame, edges: DataFrame, most: int = 500) -> DataFrame:
    """Per notebook the ``most`` notes with the highest degree: ``title, degree, orphan, truncated`` (how many were left out)."""
    known = degrees(notes, edges)
    total = known.groupBy("notebook_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("notebook_id").orderBy(F.col("degree").desc(), "relative_path"))
    kept = known.withColumn("rank", rank).where(F.col("rank") <= most).join(total, "notebook_id")
    return kept.select("notebook_id", "relative_path", search_title(F.col("relative_path")).alias("title"), "degree", (F.col("degree") == 0).alias("orphan"), F.greatest(F.col("n") - most, F.lit(0)).alias("truncated"))


def capped_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between ``nodes``; a similar pair once, from its lesser path."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select("notebook_id", F.col("relative_path").alias(end)), ["notebook_id", end], "left_semi")
    once = (F.col("type") != "similar") | (F.col("source") < F.col("target"))
    mirrored = edges.where(once).select("notebook_id", "source", "target", "type", "count")
    # A similar pair that is stored one way only, from the greater path, is kept as well.
    turned = edges.where(~once).select("notebook_id", F.col("target").alias("source"), F.col("source").alias("target"), "type", "count")
    only = turned.join(mirrored.where("type = 'similar'"), ["notebook_id", "source", "target"], "left_anti").select(mirrored.columns)
    return mirrored.unionByName(only)


def node_styles(nodes: DataFrame, labels: int = 8) -> DataFrame:
    """Radius and label of each node, and where it starts on a golden-angle spiral."""
    by_degree = Window.partitionBy("notebook_id").orderBy(F.col("degree").desc(), "relative_path")
    i = F.row_number().over(by_degree) - 1
    angle: Column = F.lit(3.141592653589793 * (3 - 5**0.5)) * F.col("i")
    return nodes.withColumn("i", i).select(
        "notebook_id", "relative_path", (3 + F.least(F.lit(7.0), 2 * F.sqrt("degree"))).alias("radius"), (F.col("i") < labels).alias("labelled"),
        (F.sqrt("i") * 24 * F.cos(angle)).alias("x"), (F.sqrt("i") * 24 * F.sin(angle)).alias("y"),
    )
