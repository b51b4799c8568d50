import pytest
from pyspark.sql import functions as F

from loomnote.operators import changes, graph, mentions, similarity, wikilinks

TERM = "notebook_id string, relative_path string, term string, tf int"


def terms(spark, notes):
    rows = [("nb", p, t, n) for p, ts in notes.items() for t, n in ts.items()]
    return spark.createDataFrame(rows, TERM), spark.createDataFrame([("nb", p) for p in notes], "notebook_id string, relative_path string")


def pairs(spark, notes, threshold, plan="blocked"):
    return {(r.a, r.b): (r.sim, r.top_term) for r in similarity.similar_pairs(*terms(spark, notes), threshold, plan).collect()}


THREE = {"a": {"kubernetes": 5, "cluster": 3, "deployment": 2}, "b": {"kubernetes": 4, "cluster": 2, "pod": 3}, "c": {"javascript": 5, "react": 3, "component": 2}}


def test_frequencies(spark):
    note_term, _ = terms(spark, {"a": {"kubernetes": 3, "container": 1}, "b": {"docker": 2, "container": 5}})
    df = similarity.document_frequency(note_term)
    assert {r.term: r.df for r in df.collect()} == {"kubernetes": 1, "docker": 1, "container": 2}
    after = similarity.frequency_change(df, note_term.where("relative_path = 'a'"), terms(spark, {"a": {"kubernetes": 5, "service": 2}})[0])
    assert {r.term: r.df for r in after.collect()} == {"kubernetes": 1, "docker": 1, "container": 1, "service": 1}


def test_similar(spark):
    assert set(pairs(spark, THREE, 0.01)) == {("a", "b")}
    assert pairs(spark, {"a": {"common": 10, "rare": 2}, "b": {"common": 8, "rare": 1}, "c": {"common": 5}}, 0.01)[("a", "b")][1] == "rare"
    assert pairs(spark, {"a": {"topic": 5}, "b": {"topic": 3}}, 0.01) == {}
    assert pairs(spark, {"a": {"topic": 5}, "b": {"topic": 3}, "c": {"other": 1}}, 0.01)[("a", "b")][0] == pytest.approx(1)
    edges = similarity.similar_edges(similarity.similar_pairs(*terms(spark, {"a": {"topic": 5}, "b": {"topic": 3}, "c": {"other": 1}})))
    assert sorted((r.source, r.target, r["count"]) for r in edges.collect()) == [("a", "b", 100), ("b", "a", 100)]


def test_plans_agree_and_blocks_split(spark, monkeypatch):
    import random

    rng = random.Random(2)
    notes = {f"n{i}": {f"t{int(rng.paretovariate(0.6)) % 90}": rng.randint(1, 9) for _ in range(25)} for i in range(70)}
    plain = pairs(spark, notes, 0.15, "plain")
    monkeypatch.setattr(similarity, "BLOCK", 16)
    for dense in (0.0, 0.2, 2.0):
        monkeypatch.setattr(similarity, "DENSE", dense)
        got = pairs(spark, notes, 0.15)
        assert {k: (round(s, 6), t) for k, (s, t) in got.items()} == {k: (round(s, 6), t) for k, (s, t) in plain.items()} and len(got) > 50


def test_blocks_are_not_sent_to_each_other(spark, monkeypatch):
    """All blocks of a notebook meet, by a shuffle of terms that doesn't grow with the number of blocks they meet."""
    import random

    from loomnote.operators import blocks

    rng = random.Random(5)
    notes = {f"n{i}": {f"é{rng.randint(1, 40)} {i % 7}": rng.randint(1, 9) for _ in range(12)} | {"über": 1} for i in range(60)} | {"copy": {"x y": 2, "x z": 2}, "copy2": {"x z": 2, "x y": 2}}
    plain = pairs(spark, notes, 0.15, "plain")
    monkeypatch.setattr(similarity, "BLOCK", 4)
    for name, value in (("TILE", 100), ("COUNTED", 100), ("COLUMNS", 5)):  # many tiles and groups, few dense terms
        monkeypatch.setattr(blocks, name, value)
    got = pairs(spark, notes, 0.15)
    assert {k: (round(s, 6), t) for k, (s, t) in got.items()} == {k: (round(s, 6), t) for k, (s, t) in plain.items()} and len(got) > 50
    assert got["copy", "copy2"][1] == "x y"
    plan = similarity.similar_pairs(*terms(spark, notes))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_terms_are_not_sent(spark):
    """Texts go to their notes before they become terms, so counting terms needs no shuffle of them; two rows of a path are one note."""
    from loomnote.operators.terms import note_terms

    notes = spark.createDataFrame([("nb", "a", "red fox"), ("nb", "a", "red hen"), ("nb", "b", None)], "notebook_id string, relative_path string, content string")
    assert {(r.relative_path, r.term): r.tf for r in note_terms(notes).collect()} == {("a", "red"): 2, ("a", "fox"): 1, ("a", "hen"): 1, ("a", "red fox"): 1, ("a", "red hen"): 1}
    plan = note_terms(notes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange")  # from the last step to the first


def test_cap_and_single_note(spark):
    notes = {"hub": {"shared": 5}, **{x: {"shared": 1, f"own{x}": 1} for x in "abcde"}, "z1": {"q": 1}, "z2": {"r": 1}, "z3": {"s": 1}}
    note_term, note = terms(spark, notes)
    found = similarity.similar_edges(similarity.similar_pairs(note_term, note, 0.1), most=2)
    assert 2 <= found.where("source = 'hub'").count() <= 5
    one = similarity.similar_for_note(note_term, note, "nb", "hub", 0.1, most=2)
    assert one.where("source = 'hub'").count() == 2 and one.where("target = 'hub'").count() == 2


def test_terms_of_a_build_stay_where_they_are(spark):
    """What a batch asks of the kept terms, by note, needs no shuffle of them; they are stored without one as well."""
    notes = spark.createDataFrame([("nb", f"n{i}.md", f"red fox {i}", "h", 0.0, "", "", "") for i in range(9)], "notebook_id string, relative_path string, content string, hash string, mtime_ms double, basename string, title string, path_text string")
    kept = changes.build(notes).note_term
    assert kept.count() == 9 * 4 and kept.where("term = 'red fox'").count() == 9  # a number of one digit is no term
    plan = kept.groupBy("notebook_id", "relative_path").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_crowded_names(spark, monkeypatch):
    """Edges of a name that many say and many have are made in parts and are not sent once made."""
    monkeypatch.setattr(mentions, "CROWD", 2)
    note_term = spark.createDataFrame([("nb", f"s{i}", t, n) for i in range(7) for t, n in (("topic", 2), (f"f{i} topic", 2 + i % 2), ("f1 topic", 2) if i != 1 else ("x", 1))] + [("nb", "lone", "f2 topic", 1)], TERM)
    paths = [f"f{i}/topic.md" for i in range(5)]
    notes = spark.createDataFrame([("nb", p) for p in paths + paths[:1]], "notebook_id string, relative_path string")
    made = mentions.mention_edges(note_term, notes)
    found = {(r.source, r.target): (r.noun, r["count"]) for r in made.collect()}
    each = {}
    for p in paths:
        for r in mentions.mention_edges(note_term, notes, target=p).collect():
            each[r.source, r.target] = (r.noun, r["count"])
    assert found == each and made.count() == len(found) == 7 * 5 + 1
    assert found["lone", "f2/topic.md"] == ("f2 topic", 1) and found["s2", "f2/topic.md"] == ("f2 topic", 4) and found["s3", "f3/topic.md"] == ("f3 topic", 5) and found["s3", "f0/topic.md"] == ("topic", 2)
    plan = mentions.mention_edges(note_term, notes)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange")  # from the last step to the first: nothing is sent after the join


def test_mentions(spark):
    def edges(notes, **kw):
        return sorted((r.source, r.target, r.noun, r["count"]) for r in mentions.mention_edges(*terms(spark, notes), **kw).collect())

    assert edges({"repairs.md": {"lantern": 5, "solder": 2}, "lantern.md": {}}) == [("repairs.md", "lantern.md", "lantern", 5)]
    assert edges({"lantern.md": {"lantern": 9}}) == []
    assert edges({"notes.md": {"ledger": 5, "shop ledger": 3}, "shop/ledger.md": {}}) == [("notes.md", "shop/ledger.md", "ledger", 8)]
    two = {"index.md": {"overview": 2}, "work/overview.md": {}, "personal/overview.md": {}}
    assert [e[1] for e in edges(two)] == ["personal/overview.md", "work/overview.md"]
    assert [e[1] for e in edges(two, target="work/overview.md")] == ["work/overview.md"]
    assert edges(two, source="work/overview.md") == []


FILES = ["overview.md", "work/overview.md", "work/projects.md", "personal/journal.md"]


def test_resolution(spark):
    def resolve(target, files=FILES):
        notes = spark.createDataFrame([("nb", f) for f in files], "notebook_id string, relative_path string")
        links = spark.createDataFrame([("nb", "s.md", 0, target)], "notebook_id string, source string, ordinal int, target string")
        return wikilinks.resolved_links(links, notes).first().resolved

    for target, want in {"projects": "work/projects.md", "PROJECTS": "work/projects.md", "work/overview": "work/overview.md", "Work/Overview": "work/overview.md", "overview": "overview.md", "journal.md": "personal/journal.md", "nonexistent": None, "": None, ".md": None}.items():
        assert resolve(target) == want, target
    assert resolve("work/overview", ["work\\overview.md"]) == "work\\overview.md"


def test_explicit_and_suggestions(spark):
    notes = spark.createDataFrame([("nb", "notes/overview.md", ""), ("nb", "docs/guide.md", ""), ("nb", "source.md", "See [[guide|the guide]] [[guide]] [[source]] [[gone]] [[guid]]")], "notebook_id string, relative_path string, content string")
    links = wikilinks.parsed_links(notes)
    assert [(r.source, r.target, r.noun, r.display_text, r["count"]) for r in wikilinks.explicit_edges(links, notes).collect()] == [("source.md", "docs/guide.md", "guide", "the guide", 100)]
    broken = wikilinks.broken_links(links, notes)
    assert sorted(r.target for r in broken.collect()) == ["gone", "guid"]
    assert [(r.target, r.relative_path, r["rank"]) for r in wikilinks.repoint_suggestions(broken, notes).collect()] == [("guid", "docs/guide.md", 1)]
    assert {r.relative_path: r.completion for r in wikilinks.completions(notes).collect()} == {"notes/overview.md": "overview", "docs/guide.md": "guide", "source.md": "source"}
    clash = spark.createDataFrame([("nb", f) for f in FILES], "notebook_id string, relative_path string")
    assert {r.completion for r in wikilinks.completions(clash, "work/projects.md").collect()} == {"overview", "work/overview", "journal"}


def edge(s, t, kind, count=1):
    return ("nb", s, t, kind, "noun", None, count)


def test_graph(spark):
    notes = spark.createDataFrame([("nb", p) for p in "abcd"], "notebook_id string, relative_path string")
    rows = [edge("a", "b", "explicit", 100), edge("a", "b", "mention", 3), edge("a", "b", "similar", 50), edge("b", "a", "similar", 50), edge("c", "a", "similar", 20), edge("a", "c", "similar", 20)]
    edges = spark.createDataFrame(rows, graph.EDGE_SCHEMA)
    assert sorted(r.relative_path for r in graph.orphans(notes, edges).collect()) == ["c", "d"]
    assert {r.relative_path: r.degree for r in graph.degrees(notes, edges).collect()} == {"a": 2, "b": 2, "c": 0, "d": 0}
    assert {r.relative_path: r.inbound for r in graph.inbound_counts(edges).collect()} == {"a": 2, "b": 3, "c": 1}
    nodes = graph.capped_nodes(notes, edges, 2)
    assert sorted((r.relative_path, r.truncated) for r in nodes.collect()) == [("a", 2), ("b", 2)]
    assert sorted((r.source, r.target, r.type) for r in graph.capped_edges(nodes, edges).collect()) == [("a", "b", "explicit"), ("a", "b", "mention"), ("a", "b", "similar")]
    assert {r.bucket for r in graph.links_of(notes, edges, "nb", "a").collect()} == {"explicit_out", "mention_out", "similar"}
    some = notes.where("relative_path = 'a'")
    new = spark.createDataFrame([edge("a", "d", "explicit", 100)], graph.EDGE_SCHEMA)
    kinds = lambda df: sorted((r.source, r.target) for r in df.where("type = 'explicit'").collect())
    assert kinds(graph.replace_outbound(edges, some, "explicit", new)) == [("a", "d")]
    assert kinds(graph.replace_inbound(edges, some, "explicit", new)) == [("a", "b"), ("a", "d")]
    assert kinds(graph.replace_type(edges, "explicit", new)) == [("a", "d")]
    assert graph.replace_symmetric(edges, some, "similar", new).where("type = 'similar'").count() == 0
    assert graph.remove_notes(edges, notes.where("relative_path = 'b'")).count() == 2
    assert graph.known_types(spark.createDataFrame([edge("a", "b", "odd")], graph.EDGE_SCHEMA)).count() == 0
    assert graph.upserted(edges, spark.createDataFrame([edge("a", "b", "mention", 9)], graph.EDGE_SCHEMA)).where("type = 'mention'").first()["count"] == 9
    styles = {r.relative_path: r for r in graph.node_styles(graph.capped_nodes(notes, edges), labels=1).collect()}
    assert styles["a"].labelled and not styles["b"].labelled and styles["d"].radius == 3


def test_renames(spark):
    def found(old, new):
        schema = "notebook_id string, relative_path string, hash string"
        return sorted((r.old_path, r.new_path) for r in changes.renames(spark.createDataFrame([("nb", *x) for x in old], schema), spark.createDataFrame([("nb", *x) for x in new], schema)).collect())

    assert found([("old.md", "abc")], [("new.md", "abc")]) == [("old.md", "new.md")]
    assert found([("old.md", "abc")], [("new.md", "x")]) == []
    assert found([("a", "1"), ("b", "2")], [("d", "2"), ("c", "1")]) == [("a", "c"), ("b", "d")]
    assert found([("a", "1"), ("b", "1")], [("c", "1")]) == [] and found([("a", "1")], [("c", "1"), ("d", "1")]) == []
    assert found([("a", None)], [("c", None)]) == []
    assert found([("a", "1"), ("b", "2"), ("e", "2")], [("c", "1"), ("d", "2")]) == [("a", "c")]


def test_diff_and_latest(spark):
    schema = "notebook_id string, relative_path string, mtime_ms double"
    old = spark.createDataFrame([("nb", "same", 1.0), ("nb", "newer", 1.0), ("nb", "older", 5.0), ("nb", "gone", 1.0)], schema)
    new = spark.createDataFrame([("nb", "same", 1.0), ("nb", "newer", 2.0), ("nb", "older", 4.0), ("nb", "come", 1.0)], schema)
    assert {r.relative_path: r.change for r in changes.snapshot_diff(old, new).collect()} == {"newer": "modified", "gone": "deleted", "come": "created"}
    events = spark.createDataFrame([("nb", "a", "create", 1), ("nb", "a", "delete", 3), ("nb", "a", "change", 2)], "notebook_id string, relative_path string, type string, seq long")
    assert [r.type for r in changes.latest_events(events).collect()] == ["delete"]
    assert [r.progress for r in changes.with_progress(spark.createDataFrame([(1, 3), (0, 0)], "d int, t int"), "d", "t").collect()] == [33, 100]


def test_batch_equals_build(spark):
    """Applying changes gives the edges of a build from scratch, whatever is created, changed, deleted or renamed."""
    from loomnote.config import EngineConfig
    from loomnote.sources.files import as_notes

    config = EngineConfig(similarity_threshold=0.05)
    old = {"a.md": "alpha beta [[b]]", "b.md": "beta gamma alpha", "x/c.md": "gamma [[a]] text", "gone.md": "will move away", "d.md": "mentions c and b. [[late]]"}
    new = {"a.md": "alpha beta [[b]]", "b.md": "changed gamma [[x/c]] delta", "moved.md": "will move away", "d.md": "mentions c and b. [[late]]", "late.md": "alpha gamma", "y/b.md": "beta"}
    frame = lambda notes: as_notes(spark.createDataFrame([("nb", p, c) for p, c in notes.items()], "notebook_id string, relative_path string, content string"))
    batch = [("nb", p, "change", c, 2) for p, c in new.items() if old.get(p) != c] + [("nb", p, "delete", None, 2) for p in old if p not in new] + [("nb", "late.md", "create", "early version", 1), ("nb", "unread.md", "create", None, 3)]
    state = changes.apply_batch(changes.build(frame(old), config), spark.createDataFrame(batch, "notebook_id string, relative_path string, type string, content string, seq long"), config)
    want = changes.build(frame(new), config)
    for table in ("edge", "note_term", "wikilink", "term_df", "note_token"):
        one, two = getattr(state, table), getattr(want, table)
        assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(map(str, two.select(sorted(one.columns)).collect())), table
    assert {r.type for r in state.edge.collect()} == {"explicit", "mention", "similar"}
    assert state.note.where(F.col("relative_path") == "late.md").first().content == "alpha gamma"


def test_a_batch_makes_similar_edges_of_its_notebooks_alone(spark, monkeypatch):
    from loomnote.sources.files import as_notes

    rows = [(nb, f"{i}.md", f"shared words of {'alpha' if i % 2 else 'beta'} {nb}{i}") for nb in ("one", "two") for i in range(6)]
    state = changes.build(as_notes(spark.createDataFrame(rows, "notebook_id string, relative_path string, content string"))).cut()
    asked, layer = [], changes.similar_layer
    monkeypatch.setattr(changes, "similar_layer", lambda note_term, note, *a, **k: asked.append({r.notebook_id for r in note.collect()}) or layer(note_term, note, *a, **k))
    batch = spark.createDataFrame([("one", "0.md", "change", "shared words of alpha", 1, 77.0)], "notebook_id string, relative_path string, type string, content string, seq long, mtime_ms double")
    after = changes.apply_batch(state, batch)
    assert asked == [{"one"}] and after.note.where("relative_path = '0.md' and notebook_id = 'one'").first().mtime_ms == 77
    monkeypatch.undo()
    new = [r if r[:2] != ("one", "0.md") else (*r[:2], "shared words of alpha") for r in rows]
    want = changes.build(as_notes(spark.createDataFrame(new, "notebook_id string, relative_path string, content string")))
    assert sorted(map(str, after.edge.select(graph.EDGE_COLUMNS).collect())) == sorted(map(str, want.edge.select(graph.EDGE_COLUMNS).collect()))


def test_best_of_each_note_without_all_pairs(spark, monkeypatch):
    """The best of each note, by blocks that meet in many rounds, are those of all pairs, copies as well; the pairs themselves are not written."""
    import random

    from loomnote.operators import blocks

    rng = random.Random(7)
    notes = {f"n{i}": {f"t{int(rng.paretovariate(0.6)) % 60}": rng.randint(1, 9) for _ in range(15)} for i in range(60)}
    notes |= {f"c{i}": {"copy": 1, "one": 2} for i in range(40)}  # 780 pairs of similarity 1
    note_term, note = terms(spark, notes)
    most = 3
    want = similarity.similar_edges(similarity.similar_pairs(note_term, note, 0.15, "plain"), most)
    monkeypatch.setattr(similarity, "BLOCK", 8)
    written, delete = [], blocks.delete

    def counted(session, path):
        if path.rsplit("/", 1)[1].isdigit():  # what a round wrote
            written.append(session.read.parquet(path).count())
        delete(session, path)

    monkeypatch.setattr(blocks, "delete", counted)
    for name, value in (("TILE", 100), ("COUNTED", 100), ("COLUMNS", 5), ("SENT", 150)):
        monkeypatch.setattr(blocks, name, value)
    got = similarity.best_edges(note_term, note, 0.15, most)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 150
    pairs = similarity.similar_pairs(note_term, note, 0.15, "plain").count()
    assert pairs > 780 and len(written) > 5 and sum(written[len(written) // 2 :]) < len(notes) * most
    assert similarity.best_edges(note_term, note, 0.15, 0).count() == 0


def test_frequencies_are_broadcast_to_blocks(spark, monkeypatch):
    """Blocks get their frequencies some at a time, and stay where they are."""
    import numpy as np

    from loomnote.operators import blocks

    seen = []
    write = blocks._finish
    monkeypatch.setattr(blocks, "_finish", lambda buckets: seen.append(buckets) or write(buckets))
    monkeypatch.setattr(blocks, "SENT", 20)
    monkeypatch.setattr(similarity, "BLOCK", 4)
    notes = {f"n{i}": {f"t{i % 5}": 1, "x y": 2, f"u{i % 3}": 3} for i in range(40)}
    plain = pairs(spark, notes, 0.15, "plain")
    got = pairs(spark, notes, 0.15)
    assert len(seen) > 2 and {k: (round(s, 6), t) for k, (s, t) in got.items()} == {k: (round(s, 6), t) for k, (s, t) in plain.items()}
    assert blocks._rounded(np.array([0.1234567885, 0.5, 0.9999999995, 1.0])).tolist() == [123456789, 500000000, 1000000000, 1000000000]


def test_term_lists_are_the_terms_and_are_not_sent(spark):
    """Terms counted where blocks are packed give the edges of ``note_term``, notes that share a path too; no text or term is shuffled."""
    from loomnote.operators import terms as extract

    rows = [("nb", f"{i}.md", f"Words of alpha{i % 4} beta{i % 3} beta{i % 3} gamma, alpha{i % 4} delta{i}") for i in range(40)]
    rows += [("nb", "3.md", "more alpha1 beta2"), ("nb", "empty.md", ""), ("nb", "none.md", None), (None, "x.md", "alpha1 beta2"), ("other", "1.md", "one two"), ("other", "2.md", "one two"), ("other", "3.md", "three")]
    notes = spark.createDataFrame(rows, "notebook_id string, relative_path string, content string")
    flat = lambda df: sorted(map(str, df.collect()))
    known = "notebook_id is not null"
    lists = extract.term_lists(notes)
    assert flat(extract.counted(lists)) == flat(extract.note_terms(notes).where(known))
    want = similarity.best_edges(extract.note_terms(notes), notes, 0.15, 3, "plain")
    assert flat(similarity.best_edges(lists, notes, 0.15, 3)) == flat(want) and want.where("notebook_id = 'other'").count() == 2
    assert flat(similarity.best_edges(lists, notes, 0.15, 3, "plain")) == flat(want)
    alone = extract.term_lists(notes.where("content not like 'more%'"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_packed_blocks_go_as_they_are_finished(spark, monkeypatch):
    """A part of the packed blocks is deleted when its blocks have their frequencies, not when all have."""
    from loomnote.operators import blocks

    seen, delete = [], blocks.delete

    def watched(session, path):
        seen.append(path.rsplit("/", 1)[1])
        delete(session, path)

    monkeypatch.setattr(blocks, "delete", watched)
    monkeypatch.setattr(blocks, "SENT", 20)
    monkeypatch.setattr(similarity, "BLOCK", 4)
    note_term, note = terms(spark, {f"n{i}": {f"t{i % 5}": 1, "x y": 2, f"u{i % 3}": 3} for i in range(40)})
    got = similarity.best_edges(note_term.repartition(4, "relative_path"), note, 0.15, 3)
    want = similarity.best_edges(note_term, note, 0.15, 3, "plain")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    gone = [x for x in seen if x.startswith("part=")]
    assert gone and len(gone) == len(set(gone)) and seen[: len(gone)] == gone


def test_frequencies_broadcast_at_a_time_are_a_quarter_of_those_sent(monkeypatch):
    """The driver of 0.75 GB could not build a broadcast of the frequencies of 60 M entries."""
    from types import SimpleNamespace

    from loomnote.operators import blocks

    sizes = [SimpleNamespace(block=i, entries=400_000) for i in range(600)]
    spans = blocks._spans(sizes)
    assert max(b - a + 1 for a, b in spans) * 400_000 <= 15_200_000
    assert [i for a, b in spans for i in range(a, b + 1)] == list(range(600))
