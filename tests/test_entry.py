import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from loomnote.plans import catalogue

SF = "/root/testdata/sf0.001"
SOME = ["tokenize_counts", "lead_preview", "phrase_filter", "match_positions", "snippets", "highlighted", "code_masked", "wikilink_parse", "wikilink_resolve", "edges_replaced_symmetric", "search_links", "links_for_note", "apply_events_similar", "apply_events_index", "explicit_edges", "similar_edges_topk", "mention_edges", "graph_edges_capped", "search_any_widened", "search_all_notebooks", "rename_pairs", "owner_notebook", "ignore_filter"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["notebook_id", "source", "target", "type", "noun", "display_text", "count"]


@pytest.mark.parametrize("name", ["inbound_count", "search_related", "graph_edges_capped", "links_for_note"])
def test_no_pairs_are_written(spark, monkeypatch, name):
    """The similar edges of the graph come from the best of each note, not from all pairs."""
    from loomnote.operators import blocks, similarity

    asked, made = [], blocks.blocked_pairs
    monkeypatch.setattr(similarity, "blocked_pairs", lambda *a: asked.append(a[5:]) or made(*a))
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert asked == [(10,)]


@pytest.mark.parametrize("name", ["inbound_count", "search_related", "graph_edges_capped", "links_for_note"])
def test_texts_and_terms_are_not_sent(spark, monkeypatch, name):
    """The similar edges of the graph are made of each note's terms where its text lies."""
    from loomnote.operators import changes

    class Seen(Exception):
        pass

    asked = []

    def layer(note_term, *_):
        asked.append((note_term.columns, "Exchange hashpartitioning" in note_term._jdf.queryExecution().executedPlan().toString()))
        raise Seen

    monkeypatch.setattr(changes, "similar_layer", layer)
    with pytest.raises(Seen):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == [(["notebook_id", "relative_path", "terms"], False)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["search_related", "graph_edges_capped", "links_for_note"])
def test_edges_are_kept_in_compressed_columns(spark, monkeypatch, name):
    """The graph's edges are written as parquet, not as whole rows of a checkpoint, and the shuffles that led to them are let go of."""
    from pathlib import Path

    from loomnote.sources.staging import shared_folder

    said, (release, staged) = [], (getattr(catalogue, x, None) for x in ("release", "staged"))
    monkeypatch.setattr(catalogue, "staged", lambda df: said.append(set(df.columns)) or staged(df), raising=False)
    monkeypatch.setattr(catalogue, "release", lambda s: said.append("release") or release(s), raising=False)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*/rdd-*"))
    assert entry.queries()[name](spark, SF).count()
    assert set(folder.glob("*/rdd-*")) == before
    needed = {"search_related": {"notebook_id", "source", "target", "type"}, "graph_edges_capped": {"notebook_id", "source", "target", "type", "count"}, "links_for_note": {"notebook_id", "source", "target", "type", "noun", "display_text", "count"}}
    assert said == [needed[name], "release"]
