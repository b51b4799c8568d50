"""Notes made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of ``note``.
NOTE_COLUMNS = ["notebook_id", "relative_path", "basename", "title", "path_text", "content", "mtime_ms", "hash"]


def document_notes(spark: SparkSession, sf_dir: str, linked: bool = False, titled: bool = False) -> DataFrame:
    """``documents`` as notes: a notebook per language, a note ``source/d<doc_id>.md`` per document.

    ``linked`` appends wikilinks made from the id: one by name, the same with a display text, one by path to the note
    itself, one that leads nowhere; and between them two that code hides. ``titled`` puts each note in a folder of its own and names it after the first
    word of five or more letters a-z of its text, so that mentions have something to hit.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    name = F.concat(F.lit("d"), F.col("doc_id"))
    if titled:
        word = F.regexp_extract(F.lower("text"), r"(?:^|[^\p{L}\p{N}_])([a-z]{5,})(?:[^\p{L}\p{N}_]|$)", 1)
        path = F.concat_ws("/", "source", name, F.concat(F.when(word == "", "untitled").otherwise(word), F.lit(".md")))
    else:
        path = F.concat_ws("/", "source", F.concat(name, F.lit(".md")))
    content = F.col("text")
    if linked:
        n = docs.agg(F.count("*").alias("n"))  # one row
        docs = docs.crossJoin(F.broadcast(n))
        other = F.concat(F.lit("D"), F.pmod(F.col("doc_id") * 7 + 1, F.col("n")))
        made = [" [[", other, "]] `[[code]]` [[", other, "|again]] [[", F.col("source"), "/", name, "]]\n```\n[[fenced]]\n```\n[[", name, "x|gone]]"]
        content = F.concat(content, *(F.lit(x) if isinstance(x, str) else x for x in made))
    return docs.select(F.col("lang").alias("notebook_id"), path.alias("relative_path"), content.alias("content"), "doc_id")
