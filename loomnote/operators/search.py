"""Search: retrieval by strictness, filters, graph-boosted BM25 ranking, and what is shown of each hit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomnote.config import EngineConfig
from loomnote.functions.text import bound, driver_tokens, has_any_word_prefix, has_phrase, has_word_prefix, lead_preview, path_text, search_title, snippets, tokens
from loomnote.operators.graph import inbound_counts, orphans
from loomnote.operators.wikilinks import resolved_links
from loomnote.plans.query_language import ParsedQuery, parse_query
from loomnote.sources.staging import cut

#: Fields and how much each weighs in the score.
BOOSTS = {"title": 4.0, "path_text": 2.0, "content": 1.0}
K1, B, D = 1.2, 0.75, 0.5
#: Terms shorter than this are never matched with a typo.
FUZZY_LENGTH = 4
KEYS = ["notebook_id", "relative_path"]


def search_documents(notes: DataFrame) -> DataFrame:
    """Notes with the fields that are searched."""
    path = F.col("relative_path")
    return notes.select(*KEYS, search_title(path).alias("title"), path_text(path).alias("path_text"), F.coalesce("content", F.lit("")).alias("content"))


def _fields(documents: DataFrame, words=lambda ws: ws, names: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """``notebook_id, relative_path, field, field_len, words``: a row for each field of each note; ``words`` may narrow the tokens kept."""
    made = lambda f: bound(tokens(F.col(f)), lambda ws: F.struct(F.lit(f).alias("field"), F.size(ws).alias("field_len"), words(ws).alias("words")))
    return documents.select(*KEYS, F.explode(F.array(*map(made, names))).alias("x")).select(*KEYS, "x.*")


def _counted(fields: DataFrame) -> DataFrame:
    rows = fields.select(*KEYS, "field", "field_len", F.explode("words").alias("token"))
    return rows.groupBy(*KEYS, "field", "token").agg(F.count("*").cast("int").alias("tf"), F.first("field_len").alias("field_len"))


def note_tokens(documents: DataFrame) -> DataFrame:
    """The index: ``notebook_id, relative_path, field, token, tf, field_len``."""
    return _counted(_fields(documents))


def field_stats(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Per notebook and field: notes and average words, from the index alone but for the number of notes."""
    n = documents.groupBy("notebook_id").agg(F.count("*").alias("n_docs"))
    total = index.groupBy("notebook_id", "field").agg(F.sum("tf").alias("total"))
    return total.join(n, "notebook_id").select("notebook_id", "field", "n_docs", (F.col("total") / F.col("n_docs")).alias("avg_len"))


def index_for(documents: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """The part of the index that a query can hit, and the statistics, in one pass over notes that have no index yet.

    Tokens that no term matches are dropped inside each note, before anything becomes a row.
    """
    terms, searched = retrieval_terms(parse_query(raw))
    fields = _fields(documents, lambda ws: F.filter(ws, lambda w: matches(w, terms)), searched)
    fields = cut(fields) if terms else fields  # by filters alone nothing is read
    stats = fields.groupBy("notebook_id", "field").agg(F.count("*").alias("n_docs"), F.avg("field_len").alias("avg_len"))
    return _counted(fields), stats


def retrieval_terms(q: ParsedQuery) -> tuple[list[str], tuple[str, ...]]:
    """The words to look for and the fields to look in: title: and path: narrow the fields only if nothing else is asked."""
    words = [*q.terms, *(w for p in q.phrases for w in p.split()), *q.title, *q.path]
    if q.terms or q.phrases or not (q.title or q.path):
        fields = tuple(BOOSTS)
    else:
        fields = tuple(f for f, asked in (("title", q.title), ("path_text", q.path)) if asked)
    split = [t for w in words for t in driver_tokens(w)]
    return list(dict.fromkeys(split)), fields


def _near(token: Column, term: str) -> Column:
    """Whether one edit at most parts a token and a term."""
    return (F.abs(F.length(token) - len(term)) <= 1) & (F.levenshtein(token, F.lit(term), 1) >= 0)


def matches(token: Column, terms: list[str]) -> Column:
    """Whether any term is the start of a token or, if long enough, near to it."""
    tests = [token.startswith(t) for t in terms] + [_near(token, t) for t in terms if len(t) >= FUZZY_LENGTH]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def retrieve(index: DataFrame, stats: DataFrame, terms: list[str], fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """``notebook_id, relative_path, score, rung, widened``: the matches of the strictest rung that finds anything in a notebook.

    Rung 1 wants all terms, each as the start of a word; 2, with several terms, any; 3, with a term of 4 letters or
    more, any within one edit of a word. One plan serves all: a token row is matched once with each term, and a
    notebook keeps its lowest rung. Scores are BM25 by field, with the fields' boosts.
    """
    if not terms:
        return index.sparkSession.createDataFrame([], "notebook_id string, relative_path string, score double, rung int, widened boolean")
    # Terms come with the query: a handful, so what they match is one condition on the scan of the index.
    fuzzy = [t for t in terms if len(t) >= FUZZY_LENGTH]
    near = lambda t: _near(F.col("token"), t)
    exact = [F.when(F.col("token").startswith(t), F.struct(F.lit(i).alias("term"), F.lit(1).alias("rung"))) for i, t in enumerate(terms)]
    loose = [F.when(~F.col("token").startswith(t) & near(t), F.struct(F.lit(terms.index(t)).alias("term"), F.lit(3).alias("rung"))) for t in fuzzy]
    matched = index.where(F.col("field").isin(*fields) & matches(F.col("token"), terms)).select(*KEYS, "field", "tf", "field_len", F.explode(F.array_compact(F.array(*exact, *loose))).alias("m")).select(*KEYS, "field", "tf", "field_len", "m.*")
    by_field = matched.groupBy(*KEYS, "field", "term", "rung").agg(F.sum("tf").alias("tf"), F.first("field_len").alias("field_len"))
    df = by_field.groupBy("notebook_id", "field", "term", "rung").agg(F.count("*").alias("df"))
    boost = F.create_map(*(x for f, b in BOOSTS.items() for x in (F.lit(f), F.lit(b))))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = D + F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("field_len") / F.col("avg_len")))
    scored = by_field.join(df, ["notebook_id", "field", "term", "rung"]).join(stats, ["notebook_id", "field"]).withColumn("s", boost[F.col("field")] * idf * gain)
    exactly = F.col("rung") == 1
    notes = scored.groupBy(*KEYS).agg(
        F.count_distinct(F.when(exactly, F.col("term"))).alias("n_terms"), F.sum(F.when(exactly, F.col("s"))).alias("exact"), F.sum("s").alias("loose"), F.max(F.when(F.col("rung") == 3, F.lit(1)).otherwise(0)).alias("any_loose")
    )
    rung = F.when(F.col("n_terms") == len(terms), 1)
    rung = rung.when(F.col("n_terms") > 0, 2) if len(terms) > 1 else rung
    rung = rung.when(F.lit(bool(fuzzy)), 3)
    ranked = notes.withColumn("rung", rung).where("rung is not null")
    best = ranked.groupBy("notebook_id").agg(F.min("rung").alias("best"))
    # Rung 1 and 2 score exact matches; rung 3 all. A note that meets a stricter rung belongs to the looser one as well.
    kept = ranked.join(best, "notebook_id").where(F.col("rung") <= F.col("best"))
    return kept.select(*KEYS, F.when(F.col("best") == 3, F.col("loose")).otherwise(F.col("exact")).alias("score"), F.col("best").cast("int").alias("rung"), (F.col("best") == 2).alias("widened"))


def passes(q: ParsedQuery) -> Column:
    """The filters that need the note alone."""
    content, title, path = F.col("content"), F.col("title"), F.col("path_text")
    tests = [has_phrase(content, p) | has_phrase(title, p) for p in q.phrases]
    tests += [has_word_prefix(title, t) for t in q.title]
    tests += [has_word_prefix(path, t) for t in q.path]
    tests += [~(has_word_prefix(content, x) | has_word_prefix(title, x) | has_word_prefix(path, x)) for x in q.exclude]
    if q.in_folder:
        tests.append(F.lower(F.replace("relative_path", F.lit("\\"), F.lit("/"))).startswith(q.in_folder.lower() + "/"))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _linked_with(hits: DataFrame, notes: DataFrame, edges: DataFrame, target: str, related: bool) -> DataFrame:
    """Hits that link to the note that ``target`` resolves to in their notebook (or are similar to it)."""
    asked = notes.select("notebook_id").distinct().select("notebook_id", F.lit(target).alias("target"))
    known = resolved_links(asked, notes).where("resolved is not null").select("notebook_id", F.col("resolved").alias("target"))
    kind = F.col("type") == "similar" if related else F.col("type") != "similar"
    sources = edges.where(kind).join(known, ["notebook_id", "target"], "left_semi").where("source <> target").select("notebook_id", F.col("source").alias("relative_path"))
    return hits.join(sources.distinct(), KEYS, "left_semi")


def filtered(hits: DataFrame, documents: DataFrame, edges: DataFrame, q: ParsedQuery) -> DataFrame:
    """The hits that pass every filter of the query. Only keys of notes are joined; their texts stay where they are."""
    rows = documents.where(passes(q)).select(*KEYS).join(hits, KEYS)
    if q.is_orphan:
        rows = rows.join(orphans(documents, edges), KEYS, "left_semi")
    if q.links:
        rows = _linked_with(rows, documents, edges, q.links, related=False)
    if q.related:
        rows = _linked_with(rows, documents, edges, q.related, related=True)
    return rows


def candidates(documents: DataFrame, index: DataFrame, stats: DataFrame, q: ParsedQuery, config: EngineConfig = EngineConfig()) -> DataFrame:
    """What retrieval finds; with filters alone, every note with score 0."""
    if q.is_filter_only:
        return documents.select(*KEYS, F.lit(0.0).alias("score"), F.lit(0).alias("rung"), F.lit(False).alias("widened"))
    terms, fields = retrieval_terms(q)
    found = retrieve(index, stats, terms, fields)
    if config.overfetch:
        best = Window.partitionBy("notebook_id").orderBy(F.col("score").desc(), "relative_path")
        found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= config.result_limit * config.overfetch).drop("at")
    return found


def ranked(rows: DataFrame, edges: DataFrame, q: ParsedQuery) -> DataFrame:
    """Rows with their final ``score``: text score times 1 + log2(1 + inbound edges). By filters alone it stays 0."""
    if q.is_filter_only:
        return rows
    popular = rows.join(inbound_counts(edges), KEYS, "left")
    return popular.withColumn("score", F.col("score") * (1 + F.log2(1 + F.coalesce("inbound", F.lit(0))))).drop("inbound")


def present(rows: DataFrame, q: ParsedQuery, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The hit columns; snippets are cut for the rows given, so limit first."""
    terms, _ = retrieval_terms(q)
    match = lambda c, name: F.when(has_any_word_prefix(F.col(c), terms), F.lit(name))
    where = F.array_compact(F.array(match("content", "content"), match("title", "title"), match("path_text", "path")))
    shown = rows.withColumn("matched_in", where).withColumn("snippets", snippets(F.col("content"), terms, config.snippet_before, config.snippet_after))
    approximate = F.lit(False) if q.is_filter_only else F.size("matched_in") == 0
    return shown.select(
        *KEYS, "title", "score", "snippets", "matched_in", F.when(F.size("snippets") == 0, lead_preview(F.col("content"), config.preview_length)).alias("preview"), approximate.alias("approximate"), "widened", *(["rank"] if "rank" in rows.columns else [])
    )


def hit_label(approximate: Column, matched_in: Column) -> Column:
    """What a hit list says beside a hit: that it is approximate, or matched by title or path alone; else null."""
    has = lambda name: F.array_contains(matched_in, name)
    return F.when(approximate, "approximate").when(has("content"), None).when(has("title"), "title").when(has("path"), "path")


def notebooks_named(notebooks: DataFrame, typed: str) -> DataFrame:
    """``notebooks`` (with a ``name``) whose name contains ``typed``, in any case."""
    return notebooks.where(F.contains(F.lower("name"), F.lit(typed.strip().lower())))


def search(documents: DataFrame, index: DataFrame, stats: DataFrame, edges: DataFrame, raw: str, notebook_id: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Hits of one notebook (or of each, if None), the best ``result_limit``, with their ``rank``."""
    q = parse_query(raw)
    if notebook_id is not None:
        documents, index, stats, edges = (x.where(F.col("notebook_id") == notebook_id) for x in (documents, index, stats, edges))
    if q.is_empty:
        documents = documents.limit(0)
    rows = ranked(filtered(candidates(documents, index, stats, q, config), documents, edges, q), edges, q)
    order = Window.partitionBy("notebook_id").orderBy(F.round("score", 9).desc(), "relative_path")
    page = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.result_limit)
    # A page of one notebook has at most ``result_limit`` rows; of all notebooks, the size is known when it runs.
    page = F.broadcast(page) if notebook_id is not None else page
    return present(documents.join(page, KEYS), q, config)


def search_all(documents: DataFrame, index: DataFrame, stats: DataFrame, edges: DataFrame, raw: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Notebooks with hits: ``notebook_id, hits, widened, top_score, position``, the strongest first hit first, then by hits."""
    hits = search(documents, index, stats, edges, raw, None, config)
    has = lambda name: F.array_contains("matched_in", name).cast("int")
    strength = F.when(F.col("approximate"), 0).otherwise(3 * has("title") + 2 * has("path") + has("content"))
    groups = hits.withColumn("strength", strength).groupBy("notebook_id").agg(F.count("*").alias("hits"), F.max("widened").alias("widened"), F.min_by("strength", "rank").alias("top_score"))
    # One row per notebook.
    return groups.withColumn("position", F.row_number().over(Window.orderBy(F.col("top_score").desc(), F.col("hits").desc(), "notebook_id")))
