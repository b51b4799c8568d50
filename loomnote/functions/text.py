"""Text primitives as Column builders. A word is a run of letters, digits and underscores of any script."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CLASS = r"\p{L}\p{N}_"
WORD = rf"[{WORD_CLASS}]"
NOT_WORD = rf"[^{WORD_CLASS}]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` (or a lambda in it) refers to it."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """All words of a text, in lower case and in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}+"), F.lit(0))


def _quoted(term: str) -> str:
    """A term as a pattern: metacharacters escaped, for Java and Python alike."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)


def word_prefix_pattern(terms: Iterable[str]) -> str | None:
    """A pattern that finds any of ``terms`` at the start of a word, the longest first; None without terms."""
    kept = sorted({t.strip() for t in terms} - {""}, key=lambda t: (-len(t), t))
    return rf"(?<!{WORD})({'|'.join(map(_quoted, kept))})" if kept else None


def has_any_word_prefix(text: Column, terms: Iterable[str]) -> Column:
    pattern = word_prefix_pattern(terms)
    return F.lit(False) if pattern is None else F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


def has_word_prefix(text: Column, term: str) -> Column:
    return has_any_word_prefix(text, [term])


def driver_tokens(text: str) -> list[str]:
    """``tokens`` for a string at hand."""
    import regex

    return regex.findall(rf"{WORD}+", text.lower())


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` follow one another; all but the last may go on (a prefix of the word there)."""
    words = driver_tokens(phrase)
    if not words:
        return F.lit(False)
    between = rf"{WORD}*{NOT_WORD}+"
    return F.coalesce(text.rlike(rf"(?iu)(?<!{WORD}){between.join(map(_quoted, words))}(?!{WORD})"), F.lit(False))


def _matches(pattern: str | None, text: str | None) -> Iterator:
    if pattern is None or not text:
        return iter(())
    import regex

    return regex.finditer(pattern, text, regex.IGNORECASE)


def match_positions(text: Column, terms: Iterable[str]) -> Column:
    """Start offsets (in characters) of all matches of ``word_prefix_pattern``, left to right without overlap."""
    pattern = word_prefix_pattern(terms)

    @F.pandas_udf("array<int>")
    def positions(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [m.start() for m in _matches(pattern, t)])

    return positions(text)


def snippets_of(text: str | None, pattern: str | None, before: int = 40, after: int = 80) -> list[str]:
    """Windows around each match, merged where they meet; white space collapsed, "..." where cut."""
    spans: list[list[int]] = []
    for m in _matches(pattern, text):
        start, end = max(0, m.start() - before), min(len(text), m.start() + after)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [("..." if a else "") + " ".join(text[a:b].split()) + ("..." if b < len(text) else "") for a, b in spans]


def snippets(text: Column, terms: Iterable[str], before: int = 40, after: int = 80) -> Column:
    """``snippets_of`` for a column; apply it after the limit, to the rows that are shown."""
    pattern = word_prefix_pattern(terms)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippets_of(t, pattern, before, after))

    return cut(text)


def highlight(snippet: Column, terms: Iterable[str]) -> Column:
    """Mark every match in ``<mark>``."""
    pattern = word_prefix_pattern(terms)
    return snippet if pattern is None else F.regexp_replace(snippet, "(?iu)" + pattern, "<mark>$1</mark>")


# -- paths and titles --------------------------------------------------------


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def path_text(path: Column) -> Column:
    """The folders and name of a path as words: no ``.md`` in any case, separators of either kind as spaces."""
    parts = F.split(F.regexp_replace(path, r"(?i)\.md$", ""), r"[\\/]")
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    """The last segment without ``.md``, for paths with either separator."""
    return without_extension(F.element_at(_segments(F.replace(path, F.lit("\\"), F.lit("/"))), -1))


def _parent_and_name(path: Column) -> tuple[Column, Column]:
    parts = _segments(path)
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)), without_extension(F.element_at(parts, -1))


def search_title(path: Column) -> Column:
    """``parent name`` in a folder, else ``name``; case is kept."""
    parent, name = _parent_and_name(path)
    return F.concat_ws(" ", parent, name)


def link_title(path: Column) -> Column:
    return F.lower(without_extension(F.element_at(_segments(path), -1)))


def title_variants(path: Column) -> Column:
    """What a mention of a note may look like: its name, and ``parent name`` in a folder; lower case. None without a name."""
    parent, name = _parent_and_name(path)
    low, up = F.trim(F.lower(name)), F.trim(F.lower(parent))
    both = F.array_compact(F.array(low, F.when(F.coalesce(up, F.lit("")) != "", F.concat_ws(" ", up, low))))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(both)


# -- content -----------------------------------------------------------------


def content_hash(content: Column) -> Column:
    return F.sha1(content)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lead_preview(content: Column, length: int = 160) -> Column:
    """The start of a text without heading marks, white space collapsed; null if nothing is left."""
    flat = collapse(F.regexp_replace(content, r"(?m)^#{1,6}\s+", ""))
    return F.when(flat == "", F.lit(None)).when(F.length(flat) > length, F.concat(F.left(flat, F.lit(length)), F.lit("…"))).otherwise(flat)


def hover_preview(content: Column, length: int = 400) -> Column:
    flat = F.trim(content)
    return F.when(flat == "", F.lit("_Empty note._")).when(F.length(flat) > length, F.concat(F.left(flat, F.lit(length)), F.lit("…"))).otherwise(flat)


def mask_code(content: Column) -> Column:
    """Blank fenced blocks, then inline code, keeping every offset and line end. An unclosed fence stays."""
    masked = bound(_blanked(content, r"(?s)```.*?```"), lambda text: _blanked(text, r"`[^`\n]*`"))
    return F.when(F.contains(content, F.lit("`")), masked).otherwise(content)


def _blanked(text: Column, pattern: str) -> Column:
    """The text between matches woven with the matches as spaces."""

    def woven(code: Column) -> Column:
        blank = F.transform(code, lambda x: F.regexp_replace(x, r"[^\n]", " "))
        both = F.zip_with(F.split(text, pattern, -1), blank, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        return F.when(F.size(code) == 0, text).otherwise(F.array_join(F.flatten(both), ""))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), woven)


LINK = r"\[\[([^\]\[]+)\]\]"
LINK_TYPE = "array<struct<ordinal:int,target:string,display_text:string,start:int,end:int>>"


def wikilinks(content: Column) -> Column:
    """``array<struct<ordinal, target, display_text, start, end>>`` of ``[[target|display]]`` outside code; blank targets are skipped.

    Offsets come from splitting the masked text at the links: a link starts where the pieces and links before it end.
    Every intermediate value is bound, so a text is masked and split once however many links it has.
    """
    none = F.array().cast(LINK_TYPE)
    found = bound(mask_code(content), lambda masked: bound(F.regexp_extract_all(masked, F.lit(LINK), F.lit(0)), lambda links: F.when(F.size(links) == 0, none).otherwise(_placed_links(masked, links))))
    return F.when(F.contains(content, F.lit("[[")), found).otherwise(none)


def _placed_links(masked: Column, links: Column) -> Column:
    def starts_of(plain: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, i: bound(s["at"] + F.get(plain, i), lambda at: F.struct((at + F.length(F.get(links, i))).alias("at"), F.array_append(s["out"], at).alias("out")))
        return F.aggregate(F.sequence(F.lit(0), F.size(links) - 1), first, step)["out"]

    def rows(starts: Column) -> Column:
        placed = F.transform(links, lambda link, i: bound(F.get(starts, i), lambda at: _parsed_link(link, at)))
        kept = F.filter(placed, lambda x: x["target"] != "")
        return F.transform(kept, lambda x, i: F.struct(i.alias("ordinal"), *(x[c].alias(c) for c in ("target", "display_text", "start", "end"))))

    return bound(bound(F.transform(F.split(masked, LINK, -1), lambda x: F.length(x)), starts_of), rows)


def _parsed_link(link: Column, at: Column) -> Column:
    def parts(inner: Column) -> Column:
        target = F.trim(F.regexp_replace(F.substring_index(inner, "|", 1), r"^\s+|\s+$", ""))
        bar = F.instr(inner, "|")
        display = F.when(bar > 0, F.regexp_replace(F.substring(inner, bar + 1, F.length(inner)), r"^\s+|\s+$", ""))
        return F.struct(target.alias("target"), F.nullif(display, F.lit("")).alias("display_text"), at.alias("start"), (at + F.length(link)).alias("end"))

    return bound(F.substring(link, F.lit(3), F.length(link) - 4), parts)
