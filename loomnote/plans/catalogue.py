"""Registered queries of the note engine and the DuckDB SQL they must equal.

All run over whole tables. Notes are the documents (see ``sources.adapter``): a notebook per language, links and
titles made from ids and texts. Scores are rounded to 6 digits, and integers are longs, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnote.config import EngineConfig
from loomnote.functions import text as T
from loomnote.operators import changes, graph, mentions, search, similarity, terms, wikilinks
from loomnote.plans.query_language import parse_query
from loomnote.sources import files
from loomnote.sources.adapter import document_notes
from loomnote.sources.ignore import compile_rules, ignores
from loomnote.sources.staging import cut, release, staged

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
KEYS = ["notebook_id", "relative_path"]
NO_SIMILAR = EngineConfig(similarity_enabled=False)


def _query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _long(df: DataFrame) -> DataFrame:
    """Integers as longs, the type that SQL's counts have."""
    return df.select(*(F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in ("int", "smallint") else F.col(f.name) for f in df.schema.fields))


# -- pieces of SQL -----------------------------------------------------------

NOTES = "notes AS (SELECT lang AS notebook_id, source || '/d' || doc_id || '.md' AS relative_path, text AS content, doc_id FROM documents)"
LINKED = (
    "notes AS (SELECT lang AS notebook_id, source || '/d' || doc_id || '.md' AS relative_path, text || ' [[D' || o || ']] `[[code]]` [[D' || o || '|again]] [[' || source || '/d' || doc_id || ']]' || chr(10) || '```' || chr(10) || '[[fenced]]' || chr(10) || '```' || chr(10) || '[[d' || doc_id || 'x|gone]]' AS content, doc_id "
    "FROM (SELECT *, (doc_id * 7 + 1) % (SELECT count(*) FROM documents) AS o FROM documents))"
)
TITLED = (
    "notes AS (SELECT lang AS notebook_id, source || '/d' || doc_id || '/' || CASE WHEN w = '' THEN 'untitled' ELSE w END || '.md' AS relative_path, text AS content, doc_id "
    r"FROM (SELECT *, regexp_extract(lower(text), '(?:^|[^\p{L}\p{N}_])([a-z]{5,})(?:[^\p{L}\p{N}_]|$)', 1) AS w FROM documents))"
)
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
NAME = "regexp_replace(regexp_extract(relative_path, '[^/]*$'), '\\.md$', '')"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TERMS = (
    "singular AS (SELECT notebook_id, relative_path, list_transform(" + WORDS.format("content") + r", lambda x: CASE WHEN regexp_matches(x, '[a-z]{2}ies$') THEN regexp_replace(x, 'ies$', 'y') "
    r"WHEN regexp_matches(x, '(ss|x|z|ch|sh)es$') THEN regexp_replace(x, 'es$', '') WHEN regexp_matches(x, '[a-z]{2}[^siu]s$') THEN regexp_replace(x, 's$', '') ELSE x END) AS ws FROM notes), "
    f"phrases AS (SELECT notebook_id, relative_path, unnest(list_filter(ws, lambda x: x NOT IN {_list(terms.FUNCTION_WORDS)})) AS p FROM singular "
    f"UNION ALL SELECT notebook_id, relative_path, unnest(list_transform(list_filter(range(1, len(ws)), lambda i: ws[i] NOT IN {_list(terms.FUNCTION_WORDS)} AND ws[i + 1] NOT IN {_list(terms.FUNCTION_WORDS)}), lambda i: ws[i] || ' ' || ws[i + 1])) FROM singular), "
    r"cleaned AS (SELECT notebook_id, relative_path, trim(regexp_replace(trim(lower(p)), '[^0-9A-Za-z_\s-]', '', 'g')) AS term FROM phrases), "
    f"note_term AS (SELECT notebook_id, relative_path, term, count(*) AS tf FROM cleaned WHERE length(term) > 1 AND term NOT IN {_list(terms.STOP_NOUNS)} GROUP BY ALL)"
)
VECTORS = (
    "n_docs AS (SELECT notebook_id, count(*) AS n FROM notes GROUP BY 1), df AS (SELECT notebook_id, term, count(*) AS df FROM note_term GROUP BY 1, 2), "
    "weights AS (SELECT notebook_id, relative_path, term, tf * ln(n / df) AS w FROM note_term JOIN df USING (notebook_id, term) JOIN n_docs USING (notebook_id) WHERE df < n), "
    "norms AS (SELECT notebook_id, relative_path, sqrt(sum(w * w)) AS mag FROM weights GROUP BY 1, 2 HAVING sqrt(sum(w * w)) > 0), "
    "units AS (SELECT notebook_id, relative_path, term, w / mag AS u FROM weights JOIN norms USING (notebook_id, relative_path))"
)
PAIRS = (
    "pairs AS (SELECT a.notebook_id, a.relative_path AS a, b.relative_path AS b, sum(a.u * b.u) AS sim, arg_min(a.term, {'v': -round(a.u * b.u, 12), 't': a.term}) AS top_term "
    "FROM units a JOIN units b ON a.notebook_id = b.notebook_id AND a.term = b.term AND a.relative_path < b.relative_path GROUP BY ALL HAVING round(sum(a.u * b.u), 9) >= 0.15)"
)
SIMILAR = (
    "ways AS (SELECT *, a AS me, b AS other FROM pairs UNION ALL SELECT *, b, a FROM pairs), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY notebook_id, me ORDER BY round(sim, 9) DESC, other) AS r FROM ways), "
    "top AS (SELECT DISTINCT notebook_id, a, b, sim, top_term FROM best WHERE r <= 10), "
    "sim_edges AS (SELECT notebook_id, a AS source, b AS target, 'similar' AS type, top_term AS noun, NULL::VARCHAR AS display_text, CAST(floor(round(sim, 9) * 100 + 0.5) AS BIGINT) AS count FROM top "
    "UNION ALL SELECT notebook_id, b, a, 'similar', top_term, NULL, CAST(floor(round(sim, 9) * 100 + 0.5) AS BIGINT) FROM top)"
)
TITLES = (
    f"named AS (SELECT notebook_id, relative_path, trim(lower({NAME})) AS name, trim(lower(string_split(relative_path, '/')[-2])) AS parent FROM notes), "
    "titles AS (SELECT DISTINCT notebook_id, relative_path, unnest(CASE WHEN name = '' THEN [] WHEN coalesce(parent, '') = '' THEN [name] ELSE [name, parent || ' ' || name] END) AS variant FROM named)"
)
MENTIONS = (
    "mentions AS (SELECT t.notebook_id, t.relative_path AS source, v.relative_path AS target, 'mention' AS type, arg_min(t.term, {'v': -t.tf, 't': t.term}) AS noun, NULL::VARCHAR AS display_text, CAST(sum(t.tf) AS BIGINT) AS count "
    "FROM note_term t JOIN titles v ON t.notebook_id = v.notebook_id AND t.term = v.variant AND t.relative_path <> v.relative_path GROUP BY 1, 2, 3)"
)


def _masked_sql(name: str, table: str, column: str, pattern: str) -> str:
    """CTE ``name``: ``table`` with what matches ``pattern`` in ``column`` as spaces, line ends kept."""
    pieces = f"SELECT *, regexp_split_to_array({column}, '{pattern}') AS ps, regexp_extract_all({column}, '{pattern}') AS cs FROM {table}"
    woven = "array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || coalesce(regexp_replace(cs[i], '[^\\n]', ' ', 'g'), '')), '')"
    return f"{name} AS (SELECT * EXCLUDE (ps, cs) REPLACE ({woven} AS {column}) FROM ({pieces}))"


MASKED = ", ".join((_masked_sql("unfenced", "notes", "content", "(?s)```.*?```"), _masked_sql("masked", "unfenced", "content", "`[^`\\n]*`")))
LINKS = (
    MASKED + r", found AS (SELECT notebook_id, relative_path AS source, regexp_extract_all(content, '\[\[([^\]\[]+)\]\]', 1) AS ls, regexp_extract_all(content, '\[\[[^\]\[]+\]\]') AS whole, regexp_split_to_array(content, '\[\[[^\]\[]+\]\]') AS plain FROM masked), "
    "placed AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM found), "
    "begun AS (SELECT *, CAST(length(array_to_string(plain[1:i], '')) + length(array_to_string(whole[1:i - 1], '')) AS BIGINT) AS begins FROM placed), "
    'links AS (SELECT notebook_id, source, i - 1 AS ordinal, trim(string_split(ls[i], \'|\')[1]) AS target, CASE WHEN contains(ls[i], \'|\') THEN nullif(trim(ls[i][strpos(ls[i], \'|\') + 1:]), \'\') END AS display_text, begins AS "start", begins + length(whole[i]) AS "end" FROM begun)'
)
RESOLVED = (
    f"by_path AS (SELECT notebook_id, lower(regexp_replace(relative_path, '\\.md$', '')) AS key, arg_min(relative_path, {{'n': length(relative_path), 'p': relative_path}}) AS hit FROM notes GROUP BY 1, 2), "
    f"by_name AS (SELECT notebook_id, lower({NAME}) AS key, arg_min(relative_path, {{'n': length(relative_path), 'p': relative_path}}) AS hit FROM notes GROUP BY 1, 2), "
    "resolved AS (SELECT l.*, CASE WHEN contains(target, '/') THEN p.hit ELSE n.hit END AS resolved FROM links l "
    "LEFT JOIN by_path p ON p.notebook_id = l.notebook_id AND p.key = lower(regexp_replace(target, '\\.md$', '')) LEFT JOIN by_name n ON n.notebook_id = l.notebook_id AND n.key = lower(regexp_replace(target, '\\.md$', '')))"
)
EXPLICIT = (
    "explicit AS (SELECT notebook_id, source, resolved AS target, 'explicit' AS type, lower(regexp_replace(regexp_extract(resolved, '[^/]*$'), '\\.md$', '')) AS noun, arg_min_null(display_text, ordinal) AS display_text, CAST(100 AS BIGINT) AS count "
    "FROM resolved WHERE resolved IS NOT NULL AND resolved <> source GROUP BY notebook_id, source, resolved)"
)
EDGE_COLUMNS = "notebook_id, source, target, type, noun, display_text, count"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# -- text --------------------------------------------------------------------


@_query(_with(NOTES) + f"SELECT relative_path, CAST(len({WORDS.format('content')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({WORDS.format('content')})) AS BIGINT) AS n_distinct FROM notes")
def tokenize_counts(spark, sf_dir):
    words = T.tokens(F.col("content"))
    return document_notes(spark, sf_dir).select("relative_path", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def _terms(spark, sf_dir, **made):
    notes = document_notes(spark, sf_dir, **made)
    return terms.note_terms(notes), notes


def _kept_terms(spark, sf_dir):
    """Terms that are read more than once, as they are in the engine: a table."""
    note_term, notes = _terms(spark, sf_dir)
    return cut(note_term), notes


@_query(_with(NOTES, TERMS) + "SELECT notebook_id, relative_path, term, tf FROM note_term")
def term_frequency(spark, sf_dir):
    return _long(_terms(spark, sf_dir)[0])


@_query(_with(NOTES, TERMS) + f"SELECT term, count(*) AS n FROM cleaned WHERE term IN {_list(terms.STOP_NOUNS)} GROUP BY 1")
def stop_noun_terms(spark, sf_dir):
    phrases = document_notes(spark, sf_dir).select(F.explode(terms.default_phrases(F.col("content"))).alias("p"))
    return phrases.select(terms.normalised(F.col("p")).alias("term")).where(F.col("term").isin(terms.STOP_NOUNS)).groupBy("term").agg(F.count("*").alias("n"))


@_query(
    _with(TITLED)
    + f"SELECT relative_path, replace(regexp_replace(relative_path, '(?i)\\.md$', ''), '/', ' ') AS path_text, string_split(relative_path, '/')[-2] || ' ' || {NAME} AS title, lower({NAME}) AS link_title, {NAME} AS basename FROM notes"
)
def path_titles(spark, sf_dir):
    p = F.col("relative_path")
    return document_notes(spark, sf_dir, titled=True).select(p, T.path_text(p).alias("path_text"), T.search_title(p).alias("title"), T.link_title(p).alias("link_title"), T.basename(p).alias("basename"))


@_query(_with(TITLED, TITLES) + "SELECT notebook_id, variant, relative_path FROM titles")
def title_variants(spark, sf_dir):
    return mentions.title_index(document_notes(spark, sf_dir, titled=True))


@_query("SELECT doc_id, sha1(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return document_notes(spark, sf_dir).select("doc_id", T.content_hash(F.col("content")).alias("hash"))


@_query(
    r"SELECT doc_id, CASE WHEN flat = '' THEN NULL WHEN length(flat) > 160 THEN flat[:160] || '…' ELSE flat END AS preview FROM "
    r"(SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s+', '', 'g'), '\s+', ' ', 'g')) AS flat FROM documents)"
)
def lead_preview(spark, sf_dir):
    return document_notes(spark, sf_dir).select("doc_id", T.lead_preview(F.col("content")).alias("preview"))


@_query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(licens|idio)')")
def word_prefix_filter(spark, sf_dir):
    return document_notes(spark, sf_dir).where(T.has_any_word_prefix(F.col("content"), ["idio", "licens"])).select("doc_id")


@_query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])all[\p{L}\p{N}_]*[^\p{L}\p{N}_]+right[\p{L}\p{N}_]*[^\p{L}\p{N}_]+reserved([^\p{L}\p{N}_]|$)')")
def phrase_filter(spark, sf_dir):
    return document_notes(spark, sf_dir).where(T.has_phrase(F.col("content"), "all right reserved")).select("doc_id")


@_query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])licens') AND NOT regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])apache')")
def exclude_filter(spark, sf_dir):
    docs = search.search_documents(document_notes(spark, sf_dir)).where(search.passes(parse_query("-apache")) & T.has_word_prefix(F.col("content"), "licens"))
    return docs.select(F.regexp_extract("relative_path", r"d(\d+)\.md$", 1).cast("long").alias("doc_id"))


#: Offsets of the words that start with one of two terms: the lengths of what stands before each.
_STARTS = r"(?i)(^|[^\p{L}\p{N}_])(licens|idiot)"
POSITIONS = (
    f"cut AS (SELECT doc_id, text, regexp_split_to_array(text, '{_STARTS}') AS ps, regexp_extract_all(text, '{_STARTS}') AS ms, regexp_extract_all(text, '{_STARTS}', 2) AS ts FROM documents), "
    "numbered AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM cut), "
    "positions AS (SELECT doc_id, text, i, length(array_to_string(ps[1:i], '')) + length(array_to_string(ms[1:i], '')) - length(ts[i]) AS p FROM numbered)"
)


@_query(_with(POSITIONS) + "SELECT doc_id, i - 1 AS place, CAST(p AS BIGINT) AS position FROM positions")
def match_positions(spark, sf_dir):
    rows = document_notes(spark, sf_dir).select("doc_id", F.posexplode(T.match_positions(F.col("content"), ["idiot", "licens"])).alias("place", "position"))
    return _long(rows)


@_query(
    _with(
        POSITIONS,
        "windows AS (SELECT doc_id, text, i, greatest(0, p - 40) AS a, least(length(text), p + 80) AS b FROM positions)",
        "starts AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS s FROM windows)",
        "spans AS (SELECT doc_id, any_value(text) AS text, min(a) AS a, max(b) AS b, g FROM (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM starts) GROUP BY doc_id, g)",
    )
    + r"SELECT doc_id, CAST(g - 1 AS BIGINT) AS place, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(regexp_replace(text[a + 1:b], '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+', ' ', 'g')) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet FROM spans"
)
def snippets(spark, sf_dir):
    rows = document_notes(spark, sf_dir).select("doc_id", F.posexplode(T.snippets(F.col("content"), ["idiot", "licens"])).alias("place", "snippet"))
    return _long(rows)


@_query(r"SELECT doc_id, regexp_replace(text, '(?i)(^|[^\p{L}\p{N}_])(licens)', '\1<mark>\2</mark>', 'g') AS marked FROM documents")
def highlighted(spark, sf_dir):
    return document_notes(spark, sf_dir).select("doc_id", T.highlight(F.col("content"), ["licens"]).alias("marked"))


@_query("SELECT doc_id, CASE WHEN flat = '' THEN '_Empty note._' WHEN length(flat) > 400 THEN flat[:400] || '…' ELSE flat END AS preview FROM (SELECT doc_id, trim(text) AS flat FROM documents)")
def hover_preview(spark, sf_dir):
    return document_notes(spark, sf_dir).select("doc_id", T.hover_preview(F.col("content")).alias("preview"))


@_query(_with(LINKED, MASKED) + "SELECT relative_path, content AS masked FROM masked")
def code_masked(spark, sf_dir):
    return document_notes(spark, sf_dir, linked=True).select("relative_path", T.mask_code(F.col("content")).alias("masked"))


# -- wikilinks ---------------------------------------------------------------


def _linked(spark, sf_dir):
    notes = document_notes(spark, sf_dir, linked=True)
    return wikilinks.parsed_links(notes), notes


@_query(_with(LINKED, LINKS) + 'SELECT notebook_id, source, ordinal, target, display_text, "start", "end" FROM links')
def wikilink_parse(spark, sf_dir):
    return _long(_linked(spark, sf_dir)[0])


@_query(_with(LINKED, LINKS, RESOLVED) + 'SELECT source, ordinal, "start", "end", target, display_text, resolved FROM resolved')
def wikilink_spans(spark, sf_dir):
    return _long(wikilinks.resolved_spans(*_linked(spark, sf_dir)))


@_query(_with(LINKED, LINKS, RESOLVED) + "SELECT notebook_id, source, ordinal, target, resolved FROM resolved")
def wikilink_resolve(spark, sf_dir):
    return _long(wikilinks.resolved_links(*_linked(spark, sf_dir))).select("notebook_id", "source", "ordinal", "target", "resolved")


@_query(_with(LINKED, LINKS, RESOLVED, EXPLICIT) + f"SELECT {EDGE_COLUMNS} FROM explicit")
def explicit_edges(spark, sf_dir):
    return _long(wikilinks.explicit_edges(*_linked(spark, sf_dir)))


_LINKED_TO = "(SELECT min(target) FROM explicit)"


@_query(_with(LINKED, LINKS, RESOLVED, EXPLICIT) + f"SELECT {EDGE_COLUMNS} FROM explicit WHERE target = {_LINKED_TO}")
def explicit_inbound(spark, sf_dir):
    """The edges into the first note that has any."""
    links, notes = _linked(spark, sf_dir)
    target = wikilinks.explicit_edges(links, notes).agg(F.min("target")).first()[0]
    return _long(wikilinks.explicit_edges(links, notes, target))


@_query(_with(LINKED, LINKS, RESOLVED) + "SELECT notebook_id, source, ordinal, target FROM resolved WHERE resolved IS NULL")
def broken_links(spark, sf_dir):
    return _long(wikilinks.broken_links(*_linked(spark, sf_dir))).select("notebook_id", "source", "ordinal", "target")


@_query(
    _with(LINKED, LINKS, RESOLVED, f"names AS (SELECT notebook_id, relative_path, lower({NAME}) AS name FROM notes)", "wanted AS (SELECT DISTINCT notebook_id, target, lower(regexp_replace(target, '\\.md$', '')) AS w FROM resolved WHERE resolved IS NULL)")
    + "SELECT notebook_id, target, relative_path, r AS rank FROM (SELECT w.notebook_id, target, relative_path, row_number() OVER (PARTITION BY w.notebook_id, target ORDER BY relative_path) AS r "
    "FROM wanted w JOIN names n ON w.notebook_id = n.notebook_id AND (contains(name, w) OR contains(w, name))) WHERE r <= 3"
)
def repoint_suggestions(spark, sf_dir):
    links, notes = _linked(spark, sf_dir)
    return _long(wikilinks.repoint_suggestions(wikilinks.broken_links(links, notes), notes))


@_query(
    _with(TITLED)
    + f"SELECT notebook_id, relative_path, c AS completion, lpad(CAST(len(string_split(relative_path, '/')) - 1 AS VARCHAR), 3, '0') || c AS sort_text FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY notebook_id, lower({NAME})) > 1 THEN regexp_replace(relative_path, '\\.md$', '') ELSE {NAME} END AS c FROM notes)"
)
def completion_text(spark, sf_dir):
    return wikilinks.completions(document_notes(spark, sf_dir, titled=True))


# -- similarity --------------------------------------------------------------


@_query(_with(NOTES, TERMS) + "SELECT notebook_id, term, count(*) AS df FROM note_term GROUP BY 1, 2")
def doc_frequency(spark, sf_dir):
    return similarity.document_frequency(_terms(spark, sf_dir)[0])


@_query(_with(NOTES, TERMS, VECTORS) + "SELECT notebook_id, relative_path, term, round(w, 6) AS w FROM weights")
def tfidf_weights(spark, sf_dir):
    return similarity.weights(*_kept_terms(spark, sf_dir)).withColumn("w", F.round("w", 6))


@_query(_with(NOTES, TERMS, VECTORS) + "SELECT notebook_id, relative_path, round(mag, 6) AS mag FROM norms")
def doc_norms(spark, sf_dir):
    return similarity.norms(similarity.weights(*_kept_terms(spark, sf_dir))).withColumn("mag", F.round("mag", 6))


@_query(_with(NOTES, TERMS, VECTORS, PAIRS) + "SELECT notebook_id, a, b, round(sim, 6) AS sim, top_term FROM pairs")
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(*_terms(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@_query(_with(NOTES, TERMS, VECTORS, PAIRS, SIMILAR) + f"SELECT {EDGE_COLUMNS} FROM sim_edges")
def similar_edges_topk(spark, sf_dir):
    return _long(similarity.best_edges(*_terms(spark, sf_dir)))


@_query(
    _with(NOTES, TERMS, VECTORS, "asked AS (SELECT min(relative_path) AS p FROM notes WHERE notebook_id = 'en')").rstrip()
    + ", sims AS (SELECT b.notebook_id, b.relative_path AS other, sum(a.u * b.u) AS sim, arg_min(a.term, {'v': -round(a.u * b.u, 12), 't': a.term}) AS top_term FROM units a JOIN units b ON a.notebook_id = b.notebook_id AND a.term = b.term "
    "WHERE a.notebook_id = 'en' AND a.relative_path = (SELECT p FROM asked) AND b.relative_path <> a.relative_path GROUP BY 1, 2 HAVING round(sum(a.u * b.u), 9) >= 0 ORDER BY round(sum(a.u * b.u), 9) DESC, other LIMIT 10) "
    "SELECT notebook_id, unnest([(SELECT p FROM asked), other]) AS source, unnest([other, (SELECT p FROM asked)]) AS target, top_term AS noun, CAST(floor(round(sim, 9) * 100 + 0.5) AS BIGINT) AS count FROM sims"
)
def similar_for_doc(spark, sf_dir):
    note_term, notes = _kept_terms(spark, sf_dir)
    asked = notes.where("notebook_id = 'en'").agg(F.min("relative_path")).first()[0]
    return _long(similarity.similar_for_note(note_term, notes, "en", asked, threshold=0.0)).drop("type", "display_text")


# -- mentions ----------------------------------------------------------------


@_query(_with(TITLED, TERMS, TITLES, MENTIONS) + f"SELECT {EDGE_COLUMNS} FROM mentions")
def mention_edges(spark, sf_dir):
    return _long(mentions.mention_edges(*_terms(spark, sf_dir, titled=True)))


def _one_title(notes: DataFrame):
    """The path of the note that stands first in its notebook, as a fixed note to ask about."""
    return notes.agg(F.min("relative_path")).first()[0]


@_query(_with(TITLED, TERMS, TITLES, MENTIONS) + f"SELECT {EDGE_COLUMNS} FROM mentions WHERE target = (SELECT min(relative_path) FROM notes)")
def mention_inbound(spark, sf_dir):
    note_term, notes = _terms(spark, sf_dir, titled=True)
    return _long(mentions.mention_edges(note_term, notes, target=_one_title(notes)))


@_query(_with(TITLED, TERMS, TITLES, MENTIONS) + f"SELECT {EDGE_COLUMNS} FROM mentions WHERE source = (SELECT min(relative_path) FROM notes)")
def mention_outbound(spark, sf_dir):
    note_term, notes = _terms(spark, sf_dir, titled=True)
    return _long(mentions.mention_edges(note_term, notes, source=_one_title(notes)))


# -- graph -------------------------------------------------------------------

#: Explicit links and similar notes of the linked documents.
GRAPH = [LINKED, LINKS, RESOLVED, EXPLICIT, TERMS, VECTORS, PAIRS, SIMILAR, f"edges AS (SELECT {EDGE_COLUMNS} FROM explicit UNION ALL SELECT {EDGE_COLUMNS} FROM sim_edges)"]
LINK_GRAPH = [LINKED, LINKS, RESOLVED, EXPLICIT, f"edges AS (SELECT {EDGE_COLUMNS} FROM explicit)"]
DEGREE = "ends AS (SELECT notebook_id, source AS relative_path FROM edges WHERE type <> 'similar' UNION ALL SELECT notebook_id, target FROM edges WHERE type <> 'similar'), degree AS (SELECT n.notebook_id, n.relative_path, count(e.relative_path) AS degree FROM notes n LEFT JOIN ends e USING (notebook_id, relative_path) GROUP BY 1, 2)"


def _graph(spark, sf_dir, similar=True):
    links, notes = _linked(spark, sf_dir)
    edges = wikilinks.explicit_edges(links, notes)
    if similar:
        edges = graph.union_edges(edges, changes.similar_layer(terms.term_lists(notes), notes, EngineConfig()))
    return notes, edges


def _kept_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """``edges`` computed once and written in compressed columns, those named or all; the shuffles that led to them go."""
    kept, _ = staged(edges.select(*(columns or graph.EDGE_COLUMNS)))
    release(kept.sparkSession)
    return kept


@_query(_with(*LINK_GRAPH, DEGREE) + "SELECT notebook_id, relative_path FROM degree WHERE degree = 0")
def orphans(spark, sf_dir):
    return graph.orphans(*_graph(spark, sf_dir, similar=False))


@_query(_with(*LINK_GRAPH, DEGREE) + "SELECT notebook_id, relative_path, degree FROM degree")
def degree(spark, sf_dir):
    return graph.degrees(*_graph(spark, sf_dir, similar=False))


#: The note with links of most kinds, then most links, then the least path: one to ask about that has something to show.
BUSIEST = (
    "seen AS (SELECT notebook_id, source AS relative_path, type FROM edges UNION ALL SELECT notebook_id, target, type FROM edges), "
    "busiest AS (SELECT notebook_id, relative_path FROM seen GROUP BY 1, 2 ORDER BY count(DISTINCT type) DESC, count(*) DESC, relative_path, notebook_id LIMIT 1)"
)


def _busiest(edges: DataFrame) -> tuple[str, str]:
    ends = edges.select("notebook_id", "type", F.explode(F.array("source", "target")).alias("relative_path"))
    counted = ends.groupBy("notebook_id", "relative_path").agg(F.count_distinct("type").alias("kinds"), F.count("*").alias("n"))
    return tuple(counted.orderBy(F.col("kinds").desc(), F.col("n").desc(), "relative_path", "notebook_id").first()[:2])


@_query(_with(*GRAPH) + "SELECT notebook_id, target AS relative_path, count(*) AS inbound FROM edges GROUP BY 1, 2")
def inbound_count(spark, sf_dir):
    return graph.inbound_counts(_graph(spark, sf_dir)[1])


@_query(
    _with(*GRAPH, BUSIEST).rstrip()
    + ", mine AS (SELECT * FROM edges WHERE notebook_id = (SELECT notebook_id FROM busiest)), buckets AS ("
    + " UNION ALL ".join(f"SELECT '{bucket}' AS bucket, {far} AS note_path, type, noun, display_text, count FROM mine WHERE type = '{kind}' AND {near} = (SELECT relative_path FROM busiest)" for kind, bucket, near, far in (("explicit", "explicit_out", "source", "target"), ("explicit", "explicit_in", "target", "source"), ("mention", "mention_out", "source", "target"), ("mention", "mention_in", "target", "source"), ("similar", "similar", "source", "target")))
    + "), titled AS (SELECT *, lower(regexp_replace(regexp_extract(note_path, '[^/]*$'), '\\.md$', '')) AS note_title FROM buckets) "
    "SELECT bucket, note_path, note_title, type, noun, display_text, count, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN type = 'explicit' THEN 0 ELSE -count END, CASE WHEN type = 'explicit' THEN note_title END, note_path) AS rank FROM titled"
)
def links_for_note(spark, sf_dir):
    """The links of the note that has the most of each kind."""
    notes, edges = _graph(spark, sf_dir)
    edges = _kept_edges(edges)
    return _long(graph.links_of(notes, edges, *_busiest(edges)))


NODES = "nodes AS (SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY degree DESC, relative_path) AS r, count(*) OVER (PARTITION BY notebook_id) AS n FROM degree)"


@_query(_with(*LINK_GRAPH, DEGREE, NODES) + f"SELECT notebook_id, relative_path, string_split(relative_path, '/')[-2] || ' ' || {NAME} AS title, degree, degree = 0 AS orphan, greatest(n - 500, 0) AS truncated FROM nodes WHERE r <= 500")
def graph_nodes_capped(spark, sf_dir):
    return _long(graph.capped_nodes(*_graph(spark, sf_dir, similar=False), EngineConfig().graph_node_cap))


@_query(
    _with(*GRAPH, DEGREE, NODES)
    + "SELECT notebook_id, source, target, type, count FROM edges e WHERE (type <> 'similar' OR source < target) AND EXISTS (SELECT 1 FROM nodes n WHERE n.r <= 500 AND n.notebook_id = e.notebook_id AND n.relative_path = e.source) AND EXISTS (SELECT 1 FROM nodes n WHERE n.r <= 500 AND n.notebook_id = e.notebook_id AND n.relative_path = e.target)"
)
def graph_edges_capped(spark, sf_dir):
    notes, edges = _graph(spark, sf_dir)
    edges = _kept_edges(edges, "notebook_id", "source", "target", "type", "count")
    return _long(graph.capped_edges(graph.capped_nodes(notes, edges, EngineConfig().graph_node_cap), edges))


#: Links, the same ones as if they were similar notes, some notes, and edges that take the place of theirs.
CHANGED = (
    f"base AS (SELECT {EDGE_COLUMNS} FROM explicit UNION ALL SELECT {EDGE_COLUMNS.replace('type', chr(39) + 'similar' + chr(39) + ' AS type')} FROM explicit), "
    "chosen AS (SELECT notebook_id, relative_path FROM notes WHERE doc_id % 3 = 0), "
    "renewed AS (SELECT e.notebook_id, source, target, type, 'renewed' AS noun, NULL::VARCHAR AS display_text, CAST(7 AS BIGINT) AS count FROM base e JOIN chosen s ON s.notebook_id = e.notebook_id AND s.relative_path = e.source "
    "UNION ALL SELECT notebook_id, relative_path, 'new.md', 'similar', 'new', NULL, 7 FROM chosen)"
)
_IN_SOME = "EXISTS (SELECT 1 FROM chosen s WHERE s.notebook_id = e.notebook_id AND s.relative_path = {})".format
_IN_NEW = "EXISTS (SELECT 1 FROM renewed n WHERE n.notebook_id = e.notebook_id AND n.type = e.type AND n.source = e.source AND n.target = e.target)"


def _changed(spark, sf_dir):
    notes, edges = _graph(spark, sf_dir, similar=False)
    base = cut(graph.union_edges(edges, edges.withColumn("type", F.lit("similar"))))
    some = notes.where("doc_id % 3 = 0").select(*KEYS)
    theirs = base.join(some.withColumnRenamed("relative_path", "source"), ["notebook_id", "source"], "left_semi")
    renewed = theirs.withColumns({"noun": F.lit("renewed"), "display_text": F.lit(None).cast("string"), "count": F.lit(7)})
    added = some.select("notebook_id", F.col("relative_path").alias("source"), F.lit("new.md").alias("target"), F.lit("similar").alias("type"), F.lit("new").alias("noun"), F.lit(None).cast("string").alias("display_text"), F.lit(7).alias("count"))
    return base, some, graph.union_edges(renewed, added)


def _change_query(name: str, change: Callable, gone: str, new: str = "true") -> None:
    """Register a change of the edge table: those ``gone``, and those whose key is among the ``new``, give way to the new ones."""
    kept = f"SELECT {EDGE_COLUMNS} FROM base e WHERE NOT ({gone}) AND NOT ({_IN_NEW} AND {new})"
    QUERIES[name] = lambda spark, sf_dir: _long(change(*_changed(spark, sf_dir)))
    ORACLES[name] = _with(LINKED, LINKS, RESOLVED, EXPLICIT, CHANGED) + kept + (f" UNION ALL SELECT {EDGE_COLUMNS} FROM renewed" if new == "true" else "")


_change_query("edges_upserted", lambda base, some, new: graph.upserted(base, new), "false")
_change_query("edges_replaced_outbound", lambda base, some, new: graph.replace_outbound(base, some, "explicit", new), f"type = 'explicit' AND {_IN_SOME('e.source')}")
_change_query("edges_replaced_inbound", lambda base, some, new: graph.replace_inbound(base, some, "explicit", new), f"type = 'explicit' AND {_IN_SOME('e.target')}")
_change_query("edges_replaced_symmetric", lambda base, some, new: graph.replace_symmetric(base, some, "similar", new), f"type = 'similar' AND ({_IN_SOME('e.source')} OR {_IN_SOME('e.target')})")
_change_query("edges_replaced_type", lambda base, some, new: graph.replace_type(base, "similar", new.where("type = 'similar'")), "type = 'similar'", "false")
_change_query("edges_without_notes", lambda base, some, new: graph.remove_notes(base, some), f"{_IN_SOME('e.source')} OR {_IN_SOME('e.target')}", "false")
ORACLES["edges_replaced_type"] += f" UNION ALL SELECT {EDGE_COLUMNS} FROM renewed WHERE type = 'similar'"


# -- search ------------------------------------------------------------------


def _search_sql(raw: str, where: str = "true", made: str = LINKED, edges: tuple[str, ...] = (LINKS, RESOLVED, EXPLICIT, f"edges AS (SELECT {EDGE_COLUMNS} FROM explicit)"), extra: tuple[str, ...] = ()) -> str:
    """SQL of a search: rungs, BM25, boost. ``where`` are its filters, over d (the fields)."""
    q = parse_query(raw)
    head = [made, *edges, *extra, f"d AS (SELECT notebook_id, relative_path, string_split(relative_path, '/')[-2] || ' ' || {NAME} AS title, replace(regexp_replace(relative_path, '(?i)\\.md$', ''), '/', ' ') AS path_text, content FROM notes)"]
    if q.is_filter_only:
        head.append("kept AS (SELECT notebook_id, relative_path, 0.0::DOUBLE AS score, false AS widened FROM d)")
    else:
        words, fields = search.retrieval_terms(q)
        head.append("f AS (" + " UNION ALL ".join(f"SELECT notebook_id, relative_path, '{f}' AS field, {WORDS.format(f)} AS ws FROM d" for f in search.BOOSTS) + ")")
        head.append("stats AS (SELECT notebook_id, field, count(*) AS n_docs, avg(len(ws)) AS avg_len FROM f GROUP BY 1, 2)")
        head.append("tok AS (SELECT notebook_id, relative_path, field, len(ws) AS field_len, unnest(ws) AS token FROM f)")
        tests = [f"SELECT notebook_id, relative_path, field, field_len, {i} AS term, 1 AS rung FROM tok WHERE starts_with(token, '{t}')" for i, t in enumerate(words)]
        fuzzy = [t for t in words if len(t) >= search.FUZZY_LENGTH]
        tests += [f"SELECT notebook_id, relative_path, field, field_len, {words.index(t)}, 3 FROM tok WHERE NOT starts_with(token, '{t}') AND abs(length(token) - {len(t)}) <= 1 AND levenshtein(token, '{t}') <= 1" for t in fuzzy]
        head.append("hit AS (" + " UNION ALL ".join(tests) + ")")
        head.append(f"by_field AS (SELECT notebook_id, relative_path, field, term, rung, count(*) AS tf, any_value(field_len) AS field_len FROM hit WHERE field IN {_list(list(fields))} GROUP BY 1, 2, 3, 4, 5)")
        head.append("df AS (SELECT notebook_id, field, term, rung, count(*) AS df FROM by_field GROUP BY 1, 2, 3, 4)")
        boost = " ".join(f"WHEN '{f}' THEN {b}" for f, b in search.BOOSTS.items())
        gain = f"({search.D} + tf * {search.K1 + 1} / (tf + {search.K1} * ({1 - search.B} + {search.B} * field_len / avg_len)))"
        head.append(f"scored AS (SELECT b.*, CASE field {boost} END * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * {gain} AS s FROM by_field b JOIN df USING (notebook_id, field, term, rung) JOIN stats USING (notebook_id, field))")
        head.append("per AS (SELECT notebook_id, relative_path, count(DISTINCT term) FILTER (rung = 1) AS n_terms, sum(s) FILTER (rung = 1) AS exact, sum(s) AS loose FROM scored GROUP BY 1, 2)")
        any_ = "WHEN n_terms > 0 THEN 2 " if len(words) > 1 else ""
        last = "WHEN true THEN 3 " if fuzzy else ""
        head.append(f"runged AS (SELECT *, CASE WHEN n_terms = {len(words)} THEN 1 {any_}{last}END AS rung FROM per)")
        head.append("strictest AS (SELECT notebook_id, min(rung) AS best FROM runged WHERE rung IS NOT NULL GROUP BY 1)")
        head.append("kept AS (SELECT notebook_id, relative_path, CASE WHEN best = 3 THEN loose ELSE exact END AS score, best = 2 AS widened FROM runged JOIN strictest USING (notebook_id) WHERE rung <= best)")
    head.append("inbound AS (SELECT notebook_id, target AS relative_path, count(*) AS inbound FROM edges GROUP BY 1, 2)")
    score = "score" if q.is_filter_only else "score * (1 + log2(1 + coalesce(inbound, 0)))"
    head.append(f"final AS (SELECT d.*, {score} AS final_score, widened FROM kept JOIN d USING (notebook_id, relative_path) LEFT JOIN inbound USING (notebook_id, relative_path) WHERE {where})")
    head.append("page AS (SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY round(final_score, 9) DESC, relative_path) AS rank FROM final)")
    return _with(*head) + "SELECT notebook_id, relative_path, round(final_score, 6) AS score, widened, rank FROM page WHERE rank <= 20"


def _search(spark, sf_dir, raw: str, edges: DataFrame | None = None, notebook_id: str | None = None) -> DataFrame:
    links, notes = _linked(spark, sf_dir)
    edges = wikilinks.explicit_edges(links, notes) if edges is None else edges
    documents = search.search_documents(notes)
    hits = search.search(documents, *search.index_for(documents, raw), edges, raw, notebook_id)
    return _long(hits.select("notebook_id", "relative_path", F.round("score", 6).alias("score"), "widened", "rank"))


def _search_query(name: str, raw: str, where: str = "true") -> None:
    def run(spark, sf_dir):
        return _search(spark, sf_dir, raw)

    QUERIES[name], ORACLES[name] = run, _search_sql(raw, where)


_prefix = r"(?i)(^|[^\p{{L}}\p{{N}}_]){}".format
_search_query("search_all_terms", "licensed apache")
_search_query("search_any_widened", "idiot zzzzq")
_search_query("search_fuzzy", "licensse")
_search_query("search_title_scoped", "title:d12", f"regexp_matches(title, '{_prefix('d12')}')")
_search_query("search_path_scoped", "path:src1", f"regexp_matches(path_text, '{_prefix('src1')}')")
_search_query("search_in_folder", "in:src1/ the", "starts_with(lower(relative_path), 'src1/')")
_search_query("search_phrase_excluded", '"all rights reserved" -idiot', r"regexp_matches(content, '(?i)(^|[^\p{L}\p{N}_])all[\p{L}\p{N}_]*[^\p{L}\p{N}_]+rights[\p{L}\p{N}_]*[^\p{L}\p{N}_]+reserved([^\p{L}\p{N}_]|$)')" + f" AND NOT regexp_matches(content, '{_prefix('idiot')}') AND NOT regexp_matches(title, '{_prefix('idiot')}') AND NOT regexp_matches(path_text, '{_prefix('idiot')}')")
_search_query("search_orphan_in_folder", "is:orphan in:src3/", "starts_with(lower(relative_path), 'src3/') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.notebook_id = d.notebook_id AND d.relative_path IN (e.source, e.target))")
_search_query("search_boosted_rank", "idiot")


def _asked_sql(kind: str) -> str:
    """The notes with an edge of a kind to the note that ``_asked`` names."""
    name = "lower(regexp_replace(regexp_extract(target, '[^/]*$'), '\\.md$', ''))"
    asked = f"(SELECT {name} FROM edges WHERE type = '{kind}' GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"
    return f"EXISTS (SELECT 1 FROM edges e JOIN by_name t ON t.notebook_id = e.notebook_id AND t.key = {asked} AND e.target = t.hit WHERE e.type = '{kind}' AND e.source <> e.target AND e.notebook_id = d.notebook_id AND e.source = d.relative_path)"


def _asked(edges: DataFrame, kind: str) -> str:
    """The name of the note that most edges of a kind lead to (of several, the least path)."""
    most = edges.where(F.col("type") == kind).groupBy("target").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "target")
    return most.select(T.basename(F.col("target"))).first()[0]


@_query(_search_sql("links:x", _asked_sql("explicit")))
def search_links(spark, sf_dir):
    links, notes = _linked(spark, sf_dir)
    edges = cut(wikilinks.explicit_edges(links, notes))
    return _search(spark, sf_dir, f"links:{_asked(edges, 'explicit')}", edges)


@_query(_search_sql("related:x", _asked_sql("similar"), edges=tuple(GRAPH[1:])))
def search_related(spark, sf_dir):
    edges = _kept_edges(_graph(spark, sf_dir)[1], "notebook_id", "source", "target", "type")
    return _search(spark, sf_dir, f"related:{_asked(edges, 'similar')}", edges)


def _search_all_sql(raw: str, terms_: list[str]) -> str:
    inner = _search_sql(raw)
    head, tail = inner.rsplit("SELECT notebook_id, relative_path, round(final_score", 1)
    any_of = "(" + "|".join(sorted(terms_, key=lambda t: (-len(t), t))) + ")"
    has = lambda c: f"regexp_matches({c}, '{_prefix(any_of)}')"
    strength = f"CASE WHEN NOT ({has('content')} OR {has('title')} OR {has('path_text')}) THEN 0 ELSE 3 * {has('title')}::INT + 2 * {has('path_text')}::INT + {has('content')}::INT END"
    return head.rstrip() + f", groups AS (SELECT notebook_id, count(*) AS hits, bool_or(widened) AS widened, CAST(arg_min({strength}, rank) AS BIGINT) AS top_score FROM page WHERE rank <= 20 GROUP BY 1) SELECT *, row_number() OVER (ORDER BY top_score DESC, hits DESC, notebook_id) AS position FROM groups"


@_query(_search_all_sql("licensed idiot", ["licensed", "idiot"]))
def search_all_notebooks(spark, sf_dir):
    links, notes = _linked(spark, sf_dir)
    documents = search.search_documents(notes)
    raw = "licensed idiot"
    return _long(search.search_all(documents, *search.index_for(documents, raw), wikilinks.explicit_edges(links, notes), raw))


# -- changes -----------------------------------------------------------------

# Every document takes part: which change it undergoes follows from its id.
_STORED, _FOUND = "doc_id % 5 <> 0", "doc_id % 7 <> 3"


@_query(
    f"SELECT coalesce(o.notebook_id, n.notebook_id) AS notebook_id, coalesce(o.relative_path, n.relative_path) AS relative_path, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change "
    f"FROM (SELECT lang AS notebook_id, source || '/d' || doc_id || '.md' AS relative_path, doc_id FROM documents WHERE {_STORED}) o FULL JOIN (SELECT lang AS notebook_id, source || '/d' || doc_id || '.md' AS relative_path, doc_id FROM documents WHERE {_FOUND}) n USING (notebook_id, relative_path) "
    "WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR n.doc_id % 11 = 2"
)
def reconcile_diff(spark, sf_dir):
    notes = document_notes(spark, sf_dir).withColumn("mtime_ms", F.col("doc_id").cast("double"))
    found = notes.where(_FOUND).withColumn("mtime_ms", F.col("mtime_ms") + F.when(F.col("doc_id") % 11 == 2, 1).otherwise(0))
    return changes.snapshot_diff(notes.where(_STORED), found)


@_query(
    "WITH n AS (SELECT lang AS notebook_id, source || '/d' || doc_id || '.md' AS relative_path, sha1(text) AS hash, doc_id % 2 AS odd FROM documents), "
    "one AS (SELECT notebook_id, hash, odd, min(relative_path) AS p FROM n GROUP BY 1, 2, 3 HAVING count(*) = 1) "
    "SELECT o.notebook_id, o.p AS old_path, c.p AS new_path FROM one o JOIN one c USING (notebook_id, hash) WHERE o.odd = 0 AND c.odd = 1"
)
def rename_pairs(spark, sf_dir):
    notes = document_notes(spark, sf_dir).withColumn("hash", T.content_hash(F.col("content")))
    return changes.renames(notes.where("doc_id % 2 = 0"), notes.where("doc_id % 2 = 1"))


@_query("SELECT CAST(user_id AS VARCHAR) AS notebook_id, event_type AS relative_path, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def latest_event_per_path(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("notebook_id"), F.col("event_type").alias("relative_path"), F.col("event_id").alias("seq"), "value")
    return changes.latest_events(events).select("notebook_id", "relative_path", "seq", "value")


@_query(_with(NOTES, TERMS) + "SELECT notebook_id, term, count(*) AS df FROM note_term JOIN notes USING (notebook_id, relative_path) WHERE doc_id % 7 <> 3 GROUP BY 1, 2")
def df_delta(spark, sf_dir):
    """Frequencies of the found notes from those of the stored ones and the terms of what was deleted and created."""
    note_term, notes = _terms(spark, sf_dir)
    marked = note_term.join(notes.select(*KEYS, "doc_id"), KEYS)
    before = similarity.document_frequency(marked.where(_STORED))
    return similarity.frequency_change(before, marked.where(f"{_STORED} AND NOT ({_FOUND})"), marked.where(f"NOT ({_STORED}) AND {_FOUND}"))


_FINAL = LINKED.replace("notes AS (", "notes AS (SELECT * FROM (", 1) + f" WHERE {_FOUND})"


def _event_batch(spark, sf_dir):
    """Stored notes, and a batch of creations, changes and deletions that leads to the found ones."""
    notes = document_notes(spark, sf_dir, linked=True)
    old = files.as_notes(notes.where(_STORED).withColumn("content", F.when(F.col("doc_id") % 11 == 2, F.lit("old text [[d1]]")).otherwise(F.col("content"))))
    kind = F.when(~F.expr(_FOUND), "delete").when(~F.expr(_STORED), "create").when(F.col("doc_id") % 11 == 2, "change")
    return old, notes.withColumn("type", kind).where("type is not null").select(*KEYS, "type", "content", F.col("doc_id").alias("seq"))


@_query(_with(_FINAL, LINKS, RESOLVED, EXPLICIT, TERMS, TITLES, MENTIONS) + f"SELECT {EDGE_COLUMNS} FROM explicit UNION ALL SELECT {EDGE_COLUMNS} FROM mentions")
def apply_events_edges(spark, sf_dir):
    """Explicit links and mentions after a batch of creations, changes and deletions: those of a build from scratch."""
    old, batch = _event_batch(spark, sf_dir)
    return _long(changes.apply_batch(changes.build(old, NO_SIMILAR), batch, NO_SIMILAR).edge)


@_query(_with(_FINAL, *GRAPH[1:], TITLES, MENTIONS) + f"SELECT {EDGE_COLUMNS} FROM edges UNION ALL SELECT {EDGE_COLUMNS} FROM mentions")
def apply_events_similar(spark, sf_dir):
    """All edges, similar ones as well, after a batch that touches every notebook."""
    old, batch = _event_batch(spark, sf_dir)
    return _long(changes.apply_batch(changes.build(old), batch).edge)


@_query(_with(_FINAL, TERMS) + "SELECT notebook_id, term, count(*) AS df FROM note_term GROUP BY 1, 2")
def apply_events_frequencies(spark, sf_dir):
    """The kept document frequencies after a batch: the old ones with the change of each term."""
    old, batch = _event_batch(spark, sf_dir)
    return changes.apply_batch(changes.build(old, NO_SIMILAR), batch, NO_SIMILAR).term_df


@_query(
    _with(_FINAL, f"d AS (SELECT notebook_id, relative_path, string_split(relative_path, '/')[-2] || ' ' || {NAME} AS title, replace(regexp_replace(relative_path, '(?i)\\.md$', ''), '/', ' ') AS path_text, content FROM notes)")
    + "SELECT notebook_id, relative_path, field, token, count(*) AS tf, any_value(n) AS field_len FROM (SELECT *, unnest(ws) AS token, CAST(len(ws) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT notebook_id, relative_path, '{f}' AS field, {WORDS.format(f)} AS ws FROM d" for f in search.BOOSTS)
    + ")) GROUP BY 1, 2, 3, 4"
)
def apply_events_index(spark, sf_dir):
    """The kept search index after a batch."""
    old, batch = _event_batch(spark, sf_dir)
    return _long(changes.apply_batch(changes.build(old, NO_SIMILAR), batch, NO_SIMILAR).note_token)


# -- notebooks and files -----------------------------------------------------


@_query(_with(NOTES) + "SELECT notebook_id, relative_path, row_number() OVER (PARTITION BY notebook_id ORDER BY relative_path) AS place, count(*) OVER (PARTITION BY notebook_id) AS file_count FROM notes")
def notebook_listing(spark, sf_dir):
    return _long(files.notebook_listing(document_notes(spark, sf_dir)))


@_query(
    "WITH f AS (SELECT '/n/' || source || '/d' || doc_id || '/x.md' AS path FROM documents), r AS (SELECT DISTINCT '/n/' || source AS root FROM documents UNION SELECT '/n/' || source || '/d' || doc_id FROM documents WHERE doc_id % 3 = 0) "
    "SELECT path, arg_max(root, length(root)) AS notebook_id FROM f LEFT JOIN r ON starts_with(path, root || '/') GROUP BY path"
)
def owner_notebook(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, inner = F.concat(F.lit("/n/"), "source"), F.concat(F.lit("/n/"), "source", F.lit("/d"), "doc_id")
    roots = docs.select(folder.alias("notebook_id")).union(docs.where("doc_id % 3 = 0").select(inner))
    return files.owners(docs.select(F.concat(inner, F.lit("/x.md")).alias("path")), roots)


@_query("SELECT DISTINCT '/n/' || source AS notebook_id FROM documents")
def discovered_notebooks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return files.discover(docs.select(F.concat(F.lit("/n/"), "source", F.lit("/.notebook/config.json")).alias("path")))


IGNORE = "# generated\nsrc1/\n*3.md\n!d13.md\n/src2/d4?.md\n"


@_query(
    _with(NOTES)
    + r"SELECT relative_path FROM notes WHERE NOT CASE WHEN regexp_matches(relative_path, '^src2/d4[^/]\.md$') THEN true WHEN regexp_matches(relative_path, '(^|/)d13\.md$') THEN false WHEN regexp_matches(relative_path, '3\.md$') THEN true ELSE starts_with(relative_path, 'src1/') END"
)
def ignore_filter(spark, sf_dir):
    return document_notes(spark, sf_dir).where(~ignores(F.col("relative_path"), compile_rules(IGNORE))).select("relative_path")
