"""Changes: differences between snapshots, renames, batches of events, and the transition of all tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomnote.config import EngineConfig
from loomnote.operators import graph, mentions, search, similarity, terms, wikilinks
from loomnote.sources.files import as_notes
from loomnote.sources.staging import buckets, cut, dealt, release, staged

KEYS = ["notebook_id", "relative_path"]


def snapshot_diff(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``notebook_id, relative_path, change``: created (only in ``found``), deleted (only in ``stored``), modified (newer in ``found``)."""
    old = stored.select(*KEYS, F.col("mtime_ms").alias("old_ms"), F.lit(True).alias("was"))
    new = found.select(*KEYS, F.col("mtime_ms").alias("new_ms"), F.lit(True).alias("is"))
    both = old.join(new, KEYS, "full_outer")
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(F.col("new_ms") > F.col("old_ms"), "modified")
    return both.withColumn("change", change).where("change is not null").select(*KEYS, "change")


def renames(deleted: DataFrame, created: DataFrame) -> DataFrame:
    """``notebook_id, old_path, new_path`` where exactly one deletion and one creation of a notebook share a hash."""

    def lone(df: DataFrame, name: str) -> DataFrame:
        one = df.where("hash is not null").groupBy("notebook_id", "hash").agg(F.count("*").alias("n"), F.min("relative_path").alias(name))
        return one.where("n = 1").drop("n")

    return lone(deleted, "old_path").join(lone(created, "new_path"), ["notebook_id", "hash"]).select("notebook_id", "old_path", "new_path")


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each path, by ``seq``. Aggregated before the shuffle, so a path with many events is no hot key."""
    rest = [c for c in events.columns if c not in KEYS]
    return events.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("x")).select(*KEYS, "x.*")


@dataclass(frozen=True)
class Tables:
    """All tables of the engine's state, of any number of notebooks."""

    note: DataFrame
    note_term: DataFrame
    wikilink: DataFrame
    edge: DataFrame
    term_df: DataFrame
    note_token: DataFrame

    def only(self, keep: Column) -> Tables:
        """The rows of some notebooks."""
        return Tables(*(getattr(self, f.name).where(keep) for f in fields(Tables)))

    def cut(self) -> Tables:
        """The tables computed: what follows starts from them, not from all that led to them."""
        return Tables(*(cut(getattr(self, f.name)) for f in fields(Tables)))

    def with_edges(self, edge: DataFrame) -> Tables:
        return replace(self, edge=edge)


def similar_layer(note_term: DataFrame, note: DataFrame, config: EngineConfig, plan: str = "blocked", df: DataFrame | None = None) -> DataFrame:
    """All similar edges. A notebook of fewer than two notes has none; neither has any if similarity is off."""
    if not config.similarity_enabled:
        return note.sparkSession.createDataFrame([], graph.EDGE_SCHEMA)
    return similarity.best_edges(note_term, note, config.similarity_threshold, config.max_similar_per_note, plan, df)


def build(note: DataFrame, config: EngineConfig = EngineConfig(), extractor=None) -> Tables:
    """Everything from the notes: the three kinds of edges are independent branches."""
    note_term = dealt(terms.note_terms(note, extractor, config.unicode_terms, buckets(note.sparkSession)), *KEYS)  # three branches start here
    release(note.sparkSession)
    links = wikilinks.parsed_links(note)
    term_df = similarity.document_frequency(note_term)
    edge = graph.union_edges(wikilinks.explicit_edges(links, note), mentions.mention_edges(note_term, note), similar_layer(note_term, note, config))
    return Tables(note, note_term, links, edge, term_df, search.note_tokens(search.search_documents(note)))


def apply_batch(state: Tables, batch: DataFrame, config: EngineConfig = EngineConfig(), extractor=None) -> Tables:
    """The state after a batch (notebook_id, relative_path, type, content, seq; type create, change or delete; mtime_ms if known).

    The last event of a path counts; an upsert without content is skipped. A note that is deleted while a new one has
    the same hash is a rename: its terms are kept under the new path. Terms and links are made for changed notes only;
    explicit links and mentions are worked out again for what changed, and for what refers to names that appeared or
    went. Document frequencies change by a signed sum, the search index by the rows of changed notes. Similar edges
    depend on every note of their notebook: they are made anew for the notebooks that the batch touches, and stay as
    they are in all others, so that the result is that of a build from scratch. ``mtime_ms`` is when a file was
    changed; a batch that doesn't tell has the time at which it is applied.
    """
    last, _ = staged(latest_events(batch))
    now = F.unix_millis(F.current_timestamp()).cast("double")
    mtime = F.coalesce(F.col("mtime_ms").cast("double"), now) if "mtime_ms" in last.columns else now
    upserts, _ = staged(as_notes(last.where("type <> 'delete' and content is not null").withColumn("mtime_ms", mtime)))
    gone = last.where("type = 'delete'").select(KEYS)
    deleted = state.note.join(gone, KEYS, "left_semi").select(*KEYS, "hash")
    created = upserts.join(state.note.select(KEYS), KEYS, "left_anti").select(*KEYS, "hash")
    moved = cut(renames(deleted, created))

    touched = cut(upserts.select(KEYS).union(gone).distinct())
    note, _ = staged(state.note.join(touched, KEYS, "left_anti").unionByName(upserts))
    release(note.sparkSession)
    kept_terms = state.note_term.join(touched, KEYS, "left_anti")
    carried = state.note_term.join(moved.withColumnRenamed("old_path", "relative_path"), KEYS).select("notebook_id", F.col("new_path").alias("relative_path"), "term", "tf")
    fresh = upserts.join(moved.select("notebook_id", F.col("new_path").alias("relative_path")), KEYS, "left_anti")
    come = dealt(carried.unionByName(terms.note_terms(fresh, extractor, config.unicode_terms, buckets(note.sparkSession))), *KEYS)
    note_term = dealt(kept_terms.unionByName(come), *KEYS)
    release(note.sparkSession)
    term_df = similarity.frequency_change(state.term_df, state.note_term.join(touched, KEYS, "left_semi"), come)
    note_token = state.note_token.join(touched, KEYS, "left_anti").unionByName(search.note_tokens(search.search_documents(upserts)))
    as_source = touched.withColumnRenamed("relative_path", "source")
    links, _ = staged(state.wikilink.join(as_source, ["notebook_id", "source"], "left_anti").unionByName(wikilinks.parsed_links(upserts)))

    # Sources to work out again: changed notes, and those with a link or term that names a note that came or went.
    names = touched.withColumn("key", F.lower(wikilinks.basename(F.col("relative_path")))).select("notebook_id", "key").distinct()
    link_key = F.lower(wikilinks.basename(F.col("target")))
    sources = links.withColumn("key", link_key).join(names, ["notebook_id", "key"], "left_semi").select("notebook_id", "source").union(as_source).distinct()
    explicit = wikilinks.explicit_edges(links.join(sources, ["notebook_id", "source"], "left_semi"), note)
    variants = mentions.title_index(touched).select("notebook_id", F.col("variant").alias("term")).distinct()
    speakers = cut(mentions.titles_only(note_term, variants).join(variants, ["notebook_id", "term"], "left_semi").select(KEYS).union(touched).distinct())
    mention = mentions.mention_edges(note_term.join(speakers, KEYS, "left_semi"), note)
    speaking = speakers.withColumnRenamed("relative_path", "source")

    in_touched = touched.select("notebook_id").distinct()
    in_touched = F.broadcast(in_touched) if in_touched.count() < 100_000 else in_touched
    of_touched = lambda df: df.join(in_touched, "notebook_id", "left_semi")
    similar = similar_layer(of_touched(note_term), of_touched(note), config, df=of_touched(term_df))
    still = state.edge.where("type = 'similar'").join(in_touched, "notebook_id", "left_anti")
    old = graph.remove_notes(state.edge.where("type <> 'similar'"), gone)
    kept = old.where("type = 'explicit'").join(sources, ["notebook_id", "source"], "left_anti").unionByName(old.where("type = 'mention'").join(speaking, ["notebook_id", "source"], "left_anti"))
    edge = graph.union_edges(kept, explicit, mention, similar, still)
    return Tables(note, note_term, links, edge, term_df, note_token)


def reconcile_batch(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The batch that turns ``stored`` notes into ``found`` ones, for ``apply_batch``."""
    diff = snapshot_diff(stored, found)
    kind = F.when(F.col("change") == "deleted", "delete").when(F.col("change") == "created", "create").otherwise("change")
    return diff.join(found.select(*KEYS, "content", "mtime_ms"), KEYS, "left").select(*KEYS, kind.alias("type"), "content", F.coalesce("mtime_ms", F.lit(0.0)).cast("long").alias("seq"), "mtime_ms")


def with_progress(rows: DataFrame, done: str, total: str) -> DataFrame:
    """Percent of progress, rounded; 100 where there is nothing to do."""
    return rows.withColumn("progress", F.when(F.col(total) == 0, 100).otherwise(F.floor(100 * F.col(done) / F.col(total) + 0.5)).cast("int"))


