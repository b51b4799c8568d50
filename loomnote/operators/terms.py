"""Term extraction: from the text of notes to ``note_term`` (notebook_id, relative_path, term, tf)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomnote.functions.text import bound, tokens

#: Nouns that say nothing about a note (fixed values).
STOP_NOUNS = [
    "time", "way", "thing", "part", "people", "day", "year", "example", "case", "place", "point", "fact", "hand", "end", "line", "number", "group",
    "area", "world", "work", "state", "system", "program", "question", "problem", "issue", "use", "kind", "sort", "type", "form", "set", "list",
    "level", "side", "head", "home", "office", "room", "result", "change", "order", "idea", "note", "file", "page", "document", "section", "item",
    "entry", "record", "version", "name", "title", "link", "tag", "folder", "draft",
]

#: Words that no term contains when the built-in extractor is used.
FUNCTION_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he",
    "her", "his", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "she", "so", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "this", "those", "to", "up", "us", "was", "we", "were", "what", "when", "which", "who", "will",
    "with", "would", "you", "your",
]


def singular(word: Column) -> Column:
    """Rule-based singular: -ies to -y, -ses, -xes, -ches, -shes and -zes without -es, -s dropped but after s, u or i."""
    return (
        F.when(~word.endswith("s"), word)
        .when(word.rlike("[a-z]{2}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[a-z]{2}[^siu]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def _is_content(word: Column) -> Column:
    return ~word.isin(FUNCTION_WORDS)


def default_phrases(content: Column) -> Column:
    """The built-in extractor: content words in the singular, and each two that stand side by side."""

    def phrases(kept: Column) -> Column:  # function words are null here, and make what they are part of null
        pairs = F.zip_with(kept, F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(F.array_compact(kept), F.array_compact(pairs))

    singulars = F.transform(tokens(content), singular)
    return bound(F.transform(singulars, lambda w: F.when(_is_content(w), w)), phrases)


def normalised(term: Column, unicode_terms: bool = False) -> Column:
    """Lower case, without punctuation but hyphens, trimmed. By default letters beyond ASCII go as well."""
    pattern = r"[^\p{L}\p{N}_\s-]" if unicode_terms else r"[^0-9A-Za-z_\s-]"
    return F.trim(F.regexp_replace(F.trim(F.lower(term)), pattern, ""))


def _usable(term: Column) -> Column:
    return (F.length(term) > 1) & ~term.isin(STOP_NOUNS)


def terms_of(phrases: Column, decompose: bool, unicode_terms: bool = False) -> Column:
    """Phrases to terms: normalised, over one letter, no stop noun; with ``decompose`` the words of a phrase count too."""
    whole = F.filter(F.transform(phrases, lambda p: normalised(p, unicode_terms)), lambda t: F.length(t) > 1)
    if not decompose:
        return F.filter(whole, _usable)

    def decomposed(whole: Column) -> Column:
        words = F.flatten(F.transform(F.filter(whole, lambda t: t.rlike(r"\s")), lambda t: F.split(t, r"\s+")))
        parts = F.flatten(F.transform(F.filter(whole, lambda t: t.rlike("-")), lambda t: F.split(t, r"[\s-]+")))
        return bound(F.concat(whole, words), lambda all_: F.concat(all_, F.array_except(parts, all_)))

    return F.filter(bound(whole, decomposed), _usable)


def built_in_terms(content: Column, unicode_terms: bool = False) -> Column:
    """Terms of the built-in extractor. Its phrases are words in lower case, so what is ASCII is normal already."""
    normal = lambda p: F.when(F.octet_length(p) == F.length(p), p).otherwise(normalised(p, unicode_terms))
    return F.filter(F.transform(default_phrases(content), normal), _usable)


def note_terms(notes: DataFrame, extractor: Callable[[Column], Column] | None = None, unicode_terms: bool = False, parts: int | None = None) -> DataFrame:
    """Count the terms of each note. ``extractor`` maps content to an array of phrases (a UDF, say); those are decomposed.

    The result is dealt by note, over ``parts`` tasks if given.
    """
    content = F.coalesce("content", F.lit(""))
    terms = built_in_terms(content, unicode_terms) if extractor is None else terms_of(extractor(content), True, unicode_terms)
    # Texts are sent, not their terms, which take several times the room; groups by note, or note and term, need no further shuffle.
    sent = notes.select("notebook_id", "relative_path", "content").repartition(*([parts] if parts else []), "notebook_id", "relative_path")
    exploded = sent.select("notebook_id", "relative_path", F.explode(terms).alias("term"))
    return exploded.groupBy("notebook_id", "relative_path", "term").agg(F.count("*").cast("int").alias("tf"))


#: Most paths that several notes have which are broadcast.
REPEATED = 100_000


def term_lists(notes: DataFrame) -> DataFrame:
    """``notebook_id, relative_path, terms``: the built-in extractor's terms of each note as often as they occur, one row for each path.

    Neither texts nor terms are sent or grouped, so nothing is written; only notes that share a path with others are.
    """
    keys = ["notebook_id", "relative_path"]
    known = notes.where("notebook_id is not null and relative_path is not null")
    lists = lambda df: df.select(*keys, built_in_terms(F.coalesce("content", F.lit(""))).alias("terms"))
    merged = lambda df: lists(df).groupBy(*keys).agg(F.flatten(F.collect_list("terms")).alias("terms"))
    repeated = known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    n = repeated.count()
    if n == 0:
        return lists(known)
    if n > REPEATED:
        return merged(known)
    repeated = F.broadcast(repeated)
    return lists(known.join(repeated, keys, "left_anti")).unionByName(merged(known.join(repeated, keys, "left_semi")))


def counted(lists: DataFrame) -> DataFrame:
    """``term_lists`` as ``note_term``."""
    exploded = lists.select("notebook_id", "relative_path", F.explode("terms").alias("term"))
    return exploded.groupBy("notebook_id", "relative_path", "term").agg(F.count("*").cast("int").alias("tf"))
