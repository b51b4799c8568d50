import pytest
from pyspark.sql import functions as F

from loomnote.config import EngineConfig
from loomnote.engine import Engine
from loomnote.operators import changes
from loomnote.sources import files
from loomnote.sources.ignore import compile_rules, ignores
from loomnote.sources.store import Store
from loomnote.streaming.events import EVENT_SCHEMA, event_counts, follow, usable_events

OFF = EngineConfig(similarity_enabled=False)


def put(root, **content):
    for name, text in content.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "my notes"
    put(root, **{"a.md": "alpha\n[[c]]", "sub__c.md": "gamma", "x.txt": "no", "UP.MD": "no", ".notebook__m.md": "no", "inner__.notebook__k.json": "{}", "inner__d.md": "nested", "skip__e.md": "ignored"})
    return root


def test_scan(spark, tree):
    root = str(tree)
    notes = files.scan(spark, root, (f"{root}/inner",), "skip/\n")
    got = {r.relative_path: r for r in notes.collect()}
    assert set(got) == {"a.md", "sub/c.md"} and got["a.md"].content == "alpha\n[[c]]" and got["sub/c.md"].title == "sub c" and got["a.md"].mtime_ms > 1e12 and len(got["a.md"].hash) == 40


def test_scan_takes_every_name_and_leaves_nested_notebooks(spark, tree):
    root = str(tree)
    put(tree, **{"_draft.md": "draft", ".hidden.md": "hid", "_drafts__b.md": "in a folder", ".obs__c.md": "dot", ".obs___deep__.d.md": "deep", "sub___x.md": "é"})
    put(tree, **{"free__.notebook__config.json": "{}", "free__e.md": "another notebook", "free___f.md": "its own"})
    (tree / ".notebookignore").write_text("skip/\nsub/c.md\n")
    got = {r.relative_path: r for r in files.scan(spark, root).collect()}
    assert set(got) == {"a.md", "_draft.md", ".hidden.md", "_drafts/b.md", ".obs/c.md", ".obs/_deep/.d.md", "sub/_x.md"}
    assert got["sub/_x.md"].content == "é" and got["_draft.md"].mtime_ms > 1e12 and got[".obs/_deep/.d.md"].content == "deep"
    assert "sub/c.md" in {r.relative_path for r in files.scan(spark, root, ignore_text="").collect()}
    assert {r.notebook_id for r in files.notebooks_below(spark, root).collect()} == {root, f"{root}/free", f"{root}/inner"}


def test_special_names_and_empty_folders(spark, tmp_path):
    odd = tmp_path / "a [b]{c}*+%20 d"
    odd.mkdir()
    assert files.scan(spark, str(odd)).count() == 0
    put(odd, **{"x y+z%.md": "one", "_e [f].md": "two"})
    assert {(r.relative_path, r.content) for r in files.scan(spark, str(odd)).collect()} == {("x y+z%.md", "one"), ("_e [f].md", "two")}


def test_marker(spark, tmp_path):
    root = str(tmp_path / "fresh")
    assert files.mark(spark, root) and not files.mark(spark, root)
    assert (tmp_path / "fresh/.notebook/config.json").read_text() == '{"version": 1}'
    engine = Engine(spark, OFF)
    assert engine.create(root, "Fresh pages") == root and engine.discover(str(tmp_path)) == [root]
    assert [r.notebook_id for r in engine.find_notebooks("PAGE").collect()] == [root] and engine.find_notebooks("x").count() == 0


def test_roots_and_owners(spark):
    paths = spark.createDataFrame([("/n/a/.notebook/x",), ("/n/a/b/.notebook/y",), ("/n/a/node_modules/.notebook/z",), ("/.notebook/q",), ("/n/plain.md",)], "path string")
    roots = files.discover(paths)
    assert sorted(r.notebook_id for r in roots.collect()) == ["/n/a", "/n/a/b"]
    owned = files.owners(spark.createDataFrame([("/n/a/1.md",), ("/n/a/b/c/2.md",), ("/n/ab/3.md",)], "path string"), roots)
    assert {r.path: r.notebook_id for r in owned.collect()} == {"/n/a/1.md": "/n/a", "/n/a/b/c/2.md": "/n/a/b", "/n/ab/3.md": None}
    events = spark.createDataFrame([("/n/a", "1.md"), ("/n/a", "b/2.md"), ("/n/a/b", "2.md")], "notebook_id string, relative_path string")
    assert sorted(map(tuple, files.outside_nested(events, roots).collect())) == [("/n/a", "1.md"), ("/n/a/b", "2.md")]


def test_ignore_rules(spark):
    rules = compile_rules("# note\n\n*.tmp.md\nbuild/\n/top.md\ndocs/**/draft.md\n!keep.tmp.md\na?c.md\n[xy].md\n\\#odd.md\n")
    paths = {"x.tmp.md": True, "d/x.tmp.md": True, "keep.tmp.md": False, "build/a.md": True, "s/build/a.md": True, "build.md": False, "top.md": True, "s/top.md": False, "docs/draft.md": True, "docs/a/b/draft.md": True, "abc.md": True, "ac.md": False, "x.md": True, "z.md": False, "#odd.md": True, "/x.md": False, "../x.md": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.i for r in df.select("p", ignores(F.col("p"), rules).alias("i")).collect()} == paths
    assert df.where(ignores(F.col("p"), compile_rules(""))).count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.load() is None
    note = lambda rows: files.as_notes(spark.createDataFrame(rows, "notebook_id string, relative_path string, content string"))
    store.save(changes.build(note([("007", "a.md", "one [[b]]"), ("007", "b.md", "two")]), OFF))
    first = store.load()
    assert first.note.where("notebook_id = '007'").count() == 2 and first.edge.count() == 1
    store.save(changes.build(note([("007", "a.md", "one")]), OFF))
    assert store.load().note.count() == 1 and first.note.count() == 2
    assert {r.token for r in store.load().note_token.where("field = 'content'").collect()} == {"one"} and store.load().term_df.count() == 1
    store.save(store.load())
    assert len(list((tmp_path / "store").glob("snapshot-*"))) == 2  # the one before the last is gone
    store.vacuum()
    assert store.load().note.count() == 1
    (tmp_path / "store/.manifest.json.crc").unlink(missing_ok=True)
    (tmp_path / "store/manifest.json").write_text('{"format_version": 99}')
    assert store.load() is None
    (tmp_path / "store/manifest.json").write_text("not json")
    assert store.load() is None
    store.delete()
    store.delete()


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    events = tmp_path / "events"
    events.mkdir()
    (events / "1.json").write_text('{"notebook_id":"nb","relative_path":"a.md","type":"create","content":"old","seq":1}\n{"notebook_id":"nb","relative_path":"a.md","type":"change","content":"see [[b]]","seq":2}\n{"notebook_id":"nb","relative_path":"b.md","type":"create","content":"x","seq":1}\n')
    run = lambda: follow(spark, str(events), store, str(tmp_path / "cp"), once=True, config=OFF).awaitTermination()
    run()
    assert [(r.source, r.target) for r in store.load().edge.collect()] == [("a.md", "b.md")]
    (events / "2.json").write_text('{"notebook_id":"nb","relative_path":"b.md","type":"delete","seq":3}\n{"notebook_id":"nb","relative_path":"c.md","type":"create","content":"x","seq":3}\n')
    run()
    assert sorted(r.relative_path for r in store.load().note.collect()) == ["a.md", "c.md"] and store.load().edge.count() == 0
    with pytest.raises(ValueError):
        follow(spark, str(events), store, str(tmp_path / "cp"), debounce_ms=10)


def test_usable_events(spark):
    rows = [("nb", "skip/a.md", "create", "x", 1, None), ("nb", "skip/b.md", "delete", None, 1, None), ("nb", "ok.md", "change", "x", 1, 5.0)]
    got = usable_events(spark.createDataFrame(rows, EVENT_SCHEMA), None, "skip/\n").collect()
    assert sorted(r.relative_path for r in got) == ["ok.md", "skip/b.md"]


def test_event_counts(spark):
    events = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'nb' AS notebook_id, 'change' AS type UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'nb', 'change' UNION ALL SELECT timestamp'2024-01-01 00:12:00', 'nb', 'change'")
    assert sorted(r.n for r in event_counts(events).collect()) == [1, 2]


def test_engine_over_files(spark, tree, tmp_path):
    root = str(tree)
    engine = Engine(spark, OFF, Store(spark, str(tmp_path / "store")))
    engine.register(root)
    engine.register(f"{root}/inner")
    engine.build(root)
    assert sorted(r.relative_path for r in engine.notebooks().collect()) == ["a.md", "skip/e.md", "sub/c.md"]
    assert engine.links(root, "a.md").first().note_path == "sub/c.md"
    put(tree, **{"sub__c.md": "gamma changed", "new.md": "[[a]]"})
    (tree / "skip/e.md").unlink()
    import os

    os.utime(tree / "sub/c.md", (4e9, 4e9))
    assert {r.relative_path: r.type for r in engine.reconcile(root).collect()} == {"sub/c.md": "change", "new.md": "create", "skip/e.md": "delete"}
    assert engine.metadata(root, "sub/c.md").first().mtime_ms == 4e12 and engine.file_count(root) == 3
    assert engine.reconcile(root).count() == 0
    assert [(r.target, r.resolved, r.start) for r in engine.link_spans(root, "new.md").collect()] == [("a", "a.md", 0)]
    assert [r.relative_path for r in engine.search(root, "gamma changed").collect()] == ["sub/c.md"]
    assert sorted(r.relative_path for r in engine.notebooks().collect()) == ["a.md", "new.md", "sub/c.md"]
    again = Engine(spark, OFF, Store(spark, str(tmp_path / "store")))
    assert again.startup() and again.notebooks().count() == 3
    assert engine.configure(max_similar_per_note=3) and not engine.configure(max_similar_per_note=3)
    engine.unregister(root)
    assert engine.notebooks().count() == 0
