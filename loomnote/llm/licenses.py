"""License scans by diagonal voting, on DataFrame functions alone.

All runs of k words of every text are joined to the runs of k words of the notice templates. A copy of a notice
leaves hits whose offset (place in the text less place in the template) is the same: a diagonal. Hits are counted by
diagonal; diagonals next to each other, as a word put in or left out makes them, are merged; a merged span counts if
it covers enough of the template's words and is not much longer than the template.

Beside that, three phrases are counted wherever their words follow one another, and give base labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomnote.llm.common import ascii_lower
from loomnote.llm.grams import let
from loomnote.llm.license_texts import SHORT_NOTICES, WHOLE_TEXTS

#: What stands between words of the scan: all of ASCII but letters a-z and digits. Fixed by the contract of the query.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels. Fixed by the contract of the query.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: What is looked for: short notices, and whole texts.
TEMPLATES = [*SHORT_NOTICES, *((label, " ".join(text.split())) for label, text in WHOLE_TEXTS)]

#: Words of a gram; how far apart diagonals may lie to be merged; least share of a template's words that a span covers; most words of a span, as a multiple of the template's.
K, NEAR, COVER, LONGEST = 3, 3, 0.8, 1.5


def scan_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case. (ASCII texts, most often, take the fast way.)

    Splitting gives the runs that extracting them would give, for a tenth of the time, and empty strings at the ends.
    """
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def gram_hashes(words: str, k: int) -> str:
    """64-bit hashes of all runs of k words; none if there are fewer words."""
    body = f"case when size(h) < {k} then cast(array() as array<bigint>) else transform(sequence(0, size(h) - {k}), i -> xxhash64({', '.join(f'get(h, i + {j})' for j in range(k))})) end"
    return let("h", f"transform({words}, w -> xxhash64(w))", body)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """``gram, template, label, place, template_words``: a row for each gram of each template."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, label string, text string")
    rows = rows.withColumn("words", scan_words(F.col("text"))).withColumn("template_words", F.size("words"))
    return rows.select("template", "label", "template_words", F.posexplode(F.expr(gram_hashes("words", k))).alias("place", "gram"))


def notices(df: DataFrame, templates=TEMPLATES, k: int = K, near: int = NEAR, cover: float = COVER, longest: float = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: ``id_col, text_key, label, template, first_word, last_word, votes, coverage``.

    ``text_key`` is a hash of the text, so that different texts under one id stay apart; equal rows give one set of
    spans. Texts of under k words, null texts and empty tables have none. Other columns are left out.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    grams = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), scan_words(text).alias("words")).select("id", "text_key", F.posexplode(F.expr(gram_hashes("words", k))).alias("at", "gram"))
    # The templates are constants of this module or a parameter: a few thousand grams, so a broadcast is bounded.
    hits = grams.join(F.broadcast(template_grams(spark, templates, k)), "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    diagonals = hits.groupBy("id", "text_key", "template", "label", "template_words", "diagonal").agg(
        F.min("at").alias("first"), (F.max("at") + k - 1).alias("last"), F.collect_set("place").alias("places"), F.collect_set("at").alias("ats")
    )
    # A diagonal joins the one before if it is near; a merged span may hold several.
    one = Window.partitionBy("id", "text_key", "template").orderBy("diagonal")
    starts = F.when(F.col("diagonal") - F.lag("diagonal").over(one) <= near, 0).otherwise(1)
    merged = (
        diagonals.withColumn("starts", starts)
        .withColumn("span", F.sum("starts").over(one))
        .groupBy("id", "text_key", "template", "label", "template_words", "span")
        .agg(
            F.min("first").alias("first_word"), F.max("last").alias("last_word"),
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        )
    )
    covered = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + (k - 1))))))
    coverage = F.least(covered(F.col("places")), covered(F.col("ats"))) / F.col("template_words")
    spans = merged.withColumn("votes", F.size("ats")).withColumn("coverage", F.least(F.lit(1.0), coverage))
    fits = (F.col("coverage") >= cover) & (F.col("last_word") - F.col("first_word") + 1 <= longest * F.col("template_words"))
    return spans.where(fits).select(F.col("id").alias(id_col), "text_key", "label", "template", "first_word", "last_word", "votes", "coverage")


def scan(df: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices``.

    ``n_base`` counts all places of the phrases, ``first_word`` and ``last_word`` are their least and greatest start.
    ``labels`` are the phrases' and the notices'; ``score`` is 1 with a phrase, else the best coverage of a notice, or 0.
    A null text is empty: no words, empty labels. Null ids and repeated rows each keep their row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tests = []
    for n, phrase in enumerate(PHRASES):
        first, *rest = phrase.split(" ")
        tests.append(f"when w = '{first}' and " + " and ".join(f"get(words, i + {j + 1}) = '{x}'" for j, x in enumerate(rest)) + f" then i * {len(PHRASES)} + {n}")
    places = f"filter(transform(words, (w, i) -> case {' '.join(tests)} end), x -> x is not null)"
    names = F.array(*map(F.lit, PHRASES.values()))
    base = (
        df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), scan_words(text).alias("words"))
        .select("id", "text_key", F.size("words").cast("long").alias("n_words"), F.expr(let("words", "words", places)).alias("places"))
        .withColumn("starts", F.transform("places", lambda p: F.floor(p / len(PHRASES))))
        .withColumn("found", F.array_distinct(F.transform("places", lambda p: F.element_at(names, F.pmod(p, F.lit(len(PHRASES))) + 1))))
    )
    found = notices(df, templates, id_col=id_col, text_col=text_col).groupBy(F.col(id_col).alias("notice_id"), F.col("text_key").alias("notice_key")).agg(
        F.collect_set("label").alias("more"), F.max("coverage").alias("best"), F.count("*").alias("n_notices")
    )
    both = base.join(found, F.col("id").eqNullSafe(F.col("notice_id")) & (F.col("text_key") == F.col("notice_key")), "left")
    n_base = F.size("places")
    return both.select(
        F.col("id").alias(id_col), "n_words", n_base.cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("found"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("found", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
    )
