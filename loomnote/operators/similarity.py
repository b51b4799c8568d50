"""TF-IDF cosine similarity between the notes of a notebook: weights, pairs over a threshold, the best of each note.

``similar_pairs`` computes the same pairs in two ways. ``plain`` joins the term table to itself: its rows grow with
the square of a term's document frequency, so it is the reference for tests. ``blocked`` (``blocks.py``) packs notes
into blocks and compares blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.operators.blocks import DIGITS, blocked_pairs
from loomnote.operators.terms import counted

KEYS = ["notebook_id", "relative_path"]
#: Notes of a block (bounds memory: a block's entries, and a BLOCK x BLOCK matrix).
BLOCK = 768
#: Terms with at least this share of a notebook's notes are bounded before they are multiplied.
DENSE = 0.02


def document_frequency(note_term: DataFrame) -> DataFrame:
    return note_term.groupBy("notebook_id", "term").agg(F.count("*").alias("df"))


def frequency_change(before: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """``df`` after the term rows ``removed`` go and ``added`` come: a signed sum; terms that no note has are dropped."""
    delta = removed.select("notebook_id", "term", F.lit(-1).cast("long").alias("df")).unionAll(added.select("notebook_id", "term", F.lit(1).cast("long").alias("df")))
    every = before.select("notebook_id", "term", "df").unionAll(delta)
    return every.groupBy("notebook_id", "term").agg(F.sum("df").alias("df")).where("df > 0")


def weights(note_term: DataFrame, notes: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """``tf * ln(N / df)`` of each term of each note; N counts notes without terms as well. Terms of all notes weigh nothing and go.

    ``df`` is the kept table of document frequencies, if there is one.
    """
    n = notes.groupBy("notebook_id").agg(F.count("*").alias("n_docs"))
    df = (document_frequency(note_term) if df is None else df).join(n, "notebook_id").where(F.col("df") < F.col("n_docs"))
    idf = df.select("notebook_id", "term", F.log(F.col("n_docs") / F.col("df")).alias("idf"))
    return note_term.join(idf, ["notebook_id", "term"]).select(*KEYS, "term", (F.col("tf") * F.col("idf")).alias("w"))


def norms(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy(*KEYS).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("mag")).where("mag > 0")


def unit_vectors(weighted: DataFrame) -> DataFrame:
    return weighted.join(norms(weighted), KEYS).select(*KEYS, "term", (F.col("w") / F.col("mag")).alias("u"))


def similar_pairs(note_term: DataFrame, notes: DataFrame, threshold: float = 0.15, plan: str = "blocked", df: DataFrame | None = None) -> DataFrame:
    """``notebook_id, a, b, sim, top_term`` for pairs a < b with cosine >= threshold.

    ``top_term`` is the term with the largest share of the product, the least term where several have it.
    """
    if plan == "plain":
        pairs = _plain_pairs(unit_vectors(weights(note_term, notes, df)))
    else:
        pairs = blocked_pairs(note_term, notes, threshold, BLOCK, DENSE)
    return pairs.where(F.round("sim", DIGITS) >= threshold)


def _top_term():
    return F.min_by("term", F.struct(-F.round(F.col("ua") * F.col("ub"), 12), F.col("term"))).alias("top_term")


def _plain_pairs(vectors: DataFrame) -> DataFrame:
    a = vectors.select("notebook_id", F.col("relative_path").alias("a"), "term", F.col("u").alias("ua"))
    b = vectors.select("notebook_id", F.col("relative_path").alias("b"), "term", F.col("u").alias("ub"))
    both = a.join(b, ["notebook_id", "term"]).where("a < b")
    return both.groupBy("notebook_id", "a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("sim"), _top_term())


def _edges(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair as edges; ``count`` is the similarity in percent."""
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))
    percent = F.floor(F.round("sim", DIGITS) * 100 + 0.5).cast("int")
    return pairs.select("notebook_id", F.explode(ways).alias("way"), F.col("top_term").alias("noun"), percent.alias("count")).select(
        "notebook_id", "way.source", "way.target", F.lit("similar").alias("type"), "noun", F.lit(None).cast("string").alias("display_text"), "count"
    )


def similar_edges(pairs: DataFrame, most: int = 10) -> DataFrame:
    """Edges of the pairs that at least one end has among its ``most`` best (ties: the lesser path)."""
    ways = F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("other")), F.struct(F.col("b").alias("me"), F.col("a").alias("other")))
    seen = pairs.select("*", F.explode(ways).alias("way"))
    best = Window.partitionBy("notebook_id", "way.me").orderBy(F.round("sim", DIGITS).desc(), "way.other")
    kept = seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return _edges(kept.select("notebook_id", "a", "b", "sim", "top_term").distinct())


def best_edges(note_term: DataFrame, notes: DataFrame, threshold: float = 0.15, most: int = 10, plan: str = "blocked", df: DataFrame | None = None) -> DataFrame:
    """``similar_edges`` of ``similar_pairs``; by blocks no pairs are written but the ``most`` best of each note.

    ``note_term`` may be ``terms.term_lists`` as well: by blocks those are not sent.
    """
    if plan == "plain" or most < 1:
        note_term = counted(note_term) if "terms" in note_term.columns else note_term
        return similar_edges(similar_pairs(note_term, notes, threshold, plan, df), most)
    best = blocked_pairs(note_term, notes, threshold, BLOCK, DENSE, most).where(F.round("sim", DIGITS) >= threshold)
    return _edges(best.select("notebook_id", F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), "sim", "top_term").distinct())


def similar_for_note(note_term: DataFrame, notes: DataFrame, notebook_id: str, path: str, threshold: float = 0.15, most: int = 10) -> DataFrame:
    """Edges between one note and its own ``most`` best: one vector, broadcast, against all others."""
    vectors = unit_vectors(weights(note_term.where(F.col("notebook_id") == notebook_id), notes.where(F.col("notebook_id") == notebook_id)))
    mine = vectors.where(F.col("relative_path") == path).select("term", F.col("u").alias("ua"))
    others = vectors.where(F.col("relative_path") != path).select("notebook_id", F.col("relative_path").alias("other"), "term", F.col("u").alias("ub"))
    # One note's terms: bounded by the note.
    sims = others.join(F.broadcast(mine), "term").groupBy("notebook_id", "other").agg(F.sum(F.col("ua") * F.col("ub")).alias("sim"), _top_term())
    best = sims.where(F.round("sim", DIGITS) >= threshold).orderBy(F.round("sim", DIGITS).desc(), "other").limit(most)
    return _edges(best.select("notebook_id", F.lit(path).alias("a"), F.col("other").alias("b"), "sim", "top_term"))
