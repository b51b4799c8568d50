import re

from pyspark.sql import functions as F

from loomnote.functions import text as T
from loomnote.operators.terms import STOP_NOUNS, note_terms


def values(spark, column, data):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_tokens(spark):
    assert values(spark, T.tokens, ["Well-lit, the SHOP!", "café résumé", "", "a_b 1"]) == [["well", "lit", "the", "shop"], ["café", "résumé"], [], ["a_b", "1"]]


def test_prefix_and_phrase(spark):
    data = ["It is soldered", "(soldered)", "resolder"]
    assert values(spark, lambda c: T.has_word_prefix(c, "solder"), data) == [True, True, False]
    assert values(spark, lambda c: T.has_word_prefix(c, "  "), data) == [False] * 3
    assert values(spark, lambda c: T.has_phrase(c, "warm light"), ["warm, light", "warm and soft light", "light that is warm", "warm lighting", "warmer light"]) == [True, False, False, False, True]
    assert values(spark, lambda c: T.has_phrase(c, "--"), ["--"]) == [False]
    assert T.word_prefix_pattern(["tin", "tinder", " "]).endswith("(tinder|tin)")
    assert values(spark, lambda c: T.has_word_prefix(c, "c++"), ["use c++ here", "use c"]) == [True, False]
    assert T.word_prefix_pattern([]) is None


def test_positions_and_snippets(spark):
    assert values(spark, lambda c: T.match_positions(c, ["tin"]), ["tin tinned matins tinder", None]) == [[0, 4, 18], []]
    long = "x" * 100 + " key " + "y" * 300 + " key"
    (got,) = values(spark, lambda c: T.snippets(c, ["key"]), [long])
    assert len(got) == 2 and got[0].startswith("...") and got[0].endswith("...") and not got[1].endswith("...")
    assert T.snippets_of("a key b key", T.word_prefix_pattern(["key"])) == ["a key b key"]
    assert values(spark, lambda c: T.highlight(c, ["tin"]), ["Tinder"]) == ["<mark>Tin</mark>der"]


def test_paths(spark):
    paths = ["work/overview.md", "a/b/Notes.MD", "x\\y.md", "Top.md", ".md"]
    assert values(spark, T.path_text, paths) == ["work overview", "a b Notes", "x y", "Top", ""]
    assert values(spark, T.search_title, paths[:1] + paths[3:4]) == ["work overview", "Top"]
    assert values(spark, T.title_variants, ["Overview.md", "work/overview.md", "a/b/c/notes.md", ".md"]) == [["overview"], ["overview", "work overview"], ["notes", "c notes"], []]
    assert values(spark, T.basename, ["a\\b.md", "c/d"]) == ["b", "d"]
    assert values(spark, T.link_title, ["a/B.md"]) == ["b"]


def test_previews(spark):
    assert values(spark, T.lead_preview, ["# Head\n\ntext  here", " \n", "w " * 200]) == ["Head text here", None, ("w " * 80) + "…"]
    assert values(spark, T.hover_preview, ["", "short", "z" * 500]) == ["_Empty note._", "short", "z" * 400 + "…"]


def test_mask_and_links(spark):
    data = ["a [[x|y]] `[[no]]` b\n```\n[[no2]]\n``` [[  spaced  |  label  ]] [[]] [[|z]] [[p/q.md]] [[u|]]", "```open [[in]]", "[[two\nlines]]", ""]
    for text, masked, links in zip(data, values(spark, T.mask_code, data), values(spark, T.wikilinks, data)):
        assert len(masked) == len(text) and masked.count("\n") == text.count("\n")
        for x in links:
            assert re.fullmatch(r"\[\[[^\]\[]+\]\]", text[x.start : x.end])
    got = values(spark, T.wikilinks, data)
    assert [(x.ordinal, x.target, x.display_text) for x in got[0]] == [(0, "x", "y"), (1, "spaced", "label"), (2, "p/q.md", None), (3, "u", None)]
    assert [x.target for x in got[1]] == ["in"] and [x.target for x in got[2]] == ["two\nlines"] and got[3] == []


def test_terms(spark):
    assert len(STOP_NOUNS) == 58
    df = spark.createDataFrame([("n", "a.md", "The lantern stories and the lantern boxes. A day."), ("n", "b.md", None)], "notebook_id string, relative_path string, content string")
    got = {r.term: r.tf for r in note_terms(df).collect()}
    assert got["lantern"] == 2 and got["lantern story"] == 1 and got["box"] == 1 and "day" not in got and "the" not in got
    phrases = F.udf(lambda t: ["Work overview", "Café!", "state-machine", "day"] if t else [], "array<string>")
    plugged = {r.term: r.tf for r in note_terms(df, phrases).collect()}
    assert plugged == {"work overview": 1, "overview": 1, "caf": 1, "state-machine": 1, "machine": 1}
    assert "café" in {r.term for r in note_terms(df, phrases, unicode_terms=True).collect()}
