"""The engine: registration, building, searching and reading the graph of any number of notebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.config import EngineConfig
from loomnote.operators import graph, search, wikilinks
from loomnote.operators.changes import Tables, apply_batch, build, reconcile_batch, similar_layer
from loomnote.sources import files
from loomnote.sources.store import Store
from loomnote.streaming.events import not_ignored, usable_events


class Engine:
    """Holds one state for all its notebooks; every result is a DataFrame. With a ``store``, changes are published there."""

    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig(), store: Store | None = None, extractor=None):
        self.spark, self.config, self.store, self.extractor = spark, config, store, extractor
        self.roots: dict[str, dict] = {}
        self.tables = build(self._no_notes(), config, extractor).cut()
        self._forget()

    def _no_notes(self) -> DataFrame:
        return files.as_notes(self.spark.createDataFrame([], "notebook_id string, relative_path string, content string"))

    def _forget(self) -> None:
        self._index: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def _publish(self, tables: Tables) -> None:
        if self.store is None:
            self.tables = tables.cut()
        else:
            self.store.save(tables)
            self.tables = self.store.load()
        self._forget()

    # -- lifecycle --

    def health(self) -> dict:
        return {"status": "ok", "notebooks": len(self.roots), "spark": self.spark.version}

    def configure(self, **settings) -> bool:
        """Apply settings; if any changed, similar edges are worked out again."""
        self.config, changed = self.config.configured(**settings)
        if changed:
            similar = similar_layer(self.tables.note_term, self.tables.note, self.config)
            self._publish(self.tables.with_edges(graph.replace_type(self.tables.edge, "similar", similar)))
        return changed

    def register(self, root: str, name: str | None = None, ignore_text: str | None = None) -> str:
        """Register a notebook; its id is its root. Without ``ignore_text`` its ignore file on disk holds the rules."""
        root = root.rstrip("/")
        self.roots.setdefault(root, {"name": name or root.rsplit("/", 1)[-1], "status": "registered", "ignore": ignore_text})
        return root

    def create(self, root: str, name: str | None = None) -> str:
        """Make a folder a notebook (its marker is written unless there is one) and register it."""
        files.mark(self.spark, root, self.config)
        return self.register(root, name)

    def discover(self, folder: str) -> list[str]:
        """Register every notebook in a tree, by the markers on disk; gives their roots."""
        found = sorted(r.notebook_id for r in files.notebooks_below(self.spark, folder, self.config).collect())  # one short row a notebook
        return [self.register(root) for root in found]

    def unregister(self, root: str) -> None:
        """Forget a notebook and what was derived from it; its files stay."""
        self.roots.pop(root, None)
        keep = F.col("notebook_id") != root
        self._publish(self.tables.only(keep))

    def _scan(self, root: str) -> DataFrame:
        return files.scan(self.spark, root, tuple(r for r in self.roots if r != root), self.roots[root]["ignore"], self.config)

    def build(self, root: str) -> None:
        """A full build of one notebook, beside the others."""
        self.reconcile(root)

    rebuild = build

    def reconcile(self, root: str) -> DataFrame:
        """Compare a notebook's files with what is known, and apply the difference; gives the difference."""
        stored = self.tables.note.where(F.col("notebook_id") == root)
        batch = reconcile_batch(stored, self._scan(root))
        self.apply_events(batch)
        self.roots[root]["status"] = "ready"
        return batch

    def ignore_changed(self, root: str, ignore_text: str | None = None) -> DataFrame:
        """Scan again under new rules; by default those of the ignore file as it is now."""
        self.roots[root]["ignore"] = ignore_text
        return self.reconcile(root)

    def apply_events(self, batch: DataFrame, ignore_text: str = "") -> None:
        """Apply a batch of events. Rules of each registered notebook, and ``ignore_text`` for all, keep upserts of ignored files out."""
        roots = self.spark.createDataFrame([(r,) for r in self.roots], "notebook_id string") if self.roots else None
        for root, known in self.roots.items():
            batch = not_ignored(batch, known["ignore"] or "", root)
        self._publish(apply_batch(self.tables, usable_events(batch, roots, ignore_text), self.config, self.extractor))

    def load_notes(self, notes: DataFrame) -> None:
        """Build from a table of notes (notebook_id, relative_path, content)."""
        self._publish(build(files.as_notes(notes), self.config, self.extractor))

    def startup(self) -> bool:
        """Load the store's snapshot; False if there is none that can be used, so that a build is due."""
        found = self.store.load() if self.store else None
        if found is not None:
            self.tables = found
            self._forget()
        return found is not None

    # -- reads --

    def notebooks(self) -> DataFrame:
        return files.notebook_listing(self.tables.note)

    def find_notebooks(self, typed: str) -> DataFrame:
        """``notebook_id, name`` of registered notebooks whose name contains what was typed, in any case."""
        named = self.spark.createDataFrame([(root, known["name"]) for root, known in self.roots.items()], "notebook_id string, name string")
        return search.notebooks_named(named, typed)

    def metadata(self, notebook_id: str, path: str | None = None) -> DataFrame:
        """What is known of each file, or of one: ``relative_path, title, mtime_ms, hash``."""
        mine = self.tables.note.where(F.col("notebook_id") == notebook_id).select("relative_path", "title", "mtime_ms", "hash")
        return mine if path is None else mine.where(F.col("relative_path") == path)

    def file_count(self, notebook_id: str) -> int:
        return self.metadata(notebook_id).count()

    def _search_tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self._index is None:
            documents = search.search_documents(self.tables.note)
            self._index = documents, self.tables.note_token, search.field_stats(self.tables.note_token, documents)
        return self._index

    def search(self, notebook_id: str, query: str) -> DataFrame:
        return search.search(*self._search_tables(), self.tables.edge, query, notebook_id, self.config).orderBy("rank")

    def search_all(self, query: str) -> DataFrame:
        return search.search_all(*self._search_tables(), self.tables.edge, query, self.config).orderBy("position")

    def links(self, notebook_id: str, path: str) -> DataFrame:
        return graph.links_of(self.tables.note, self.tables.edge, notebook_id, path)

    def orphans(self, notebook_id: str) -> DataFrame:
        return graph.orphans(*self._of(notebook_id)).orderBy("relative_path")

    def graph(self, notebook_id: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges, capped."""
        notes, edges = self._of(notebook_id)
        nodes = graph.capped_nodes(notes, edges, self.config.graph_node_cap)
        return nodes, graph.capped_edges(nodes, edges)

    def broken_links(self, notebook_id: str) -> DataFrame:
        mine: Column = F.col("notebook_id") == notebook_id
        return wikilinks.broken_links(self.tables.wikilink.where(mine), self.tables.note.where(mine))

    def link_spans(self, notebook_id: str, path: str) -> DataFrame:
        """Where the links of a note stand and what each leads to: ``ordinal, start, end, target, display_text, resolved``."""
        mine: Column = F.col("notebook_id") == notebook_id
        return wikilinks.resolved_spans(self.tables.wikilink.where(mine & (F.col("source") == path)), self.tables.note.where(mine)).orderBy("ordinal")

    def completions(self, notebook_id: str, current: str | None = None) -> DataFrame:
        return wikilinks.completions(self.tables.note.where(F.col("notebook_id") == notebook_id), current).orderBy("sort_text")

    def _of(self, notebook_id: str) -> tuple[DataFrame, DataFrame]:
        mine = F.col("notebook_id") == notebook_id
        return self.tables.note.where(mine), self.tables.edge.where(mine)
