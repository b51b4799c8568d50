import random
from collections import Counter

import corpus_pipeline
from test_chosen_path import brute
from test_mixing import level_out

from loomnote.llm.common import documents
from loomnote.llm.queries import toxicity_chain
from loomnote.llm.toxicity import score

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(800)]
    docs, labels = [], []
    for i in range(240):
        text = rng.choices(words, k=rng.randint(8, 120))
        toxic = i % 6 == 0
        if toxic:
            text[2:2] = ["vileling", "vilery"]
        docs.append((i, " ".join(text), "en", ["a", "b", None][i % 3], 1))
        if i % 2 == 0:
            labels.append((i, int(not toxic), int(toxic)))
    docs += [(300 + i, docs[i][1] + (" more" if i % 2 else ""), "en", "b", 1) for i in range(1, 60, 2)] + [(400, docs[7][1], "en", "a", 1), (401, None, "en", "a", 0), (402, "", "en", "b", 0), (8, docs[8][1], "en", "c", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    rows = write(spark, str(tmp_path))
    docs = documents(spark, str(tmp_path))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "mixing", "packing"]

    chain = toxicity_chain(spark, docs, str(tmp_path))
    toxic = {r.doc_id for r in score(docs, chain).collect() if r.p_toxic >= 0.5}
    planted = {r[0] for r in rows if "vileling" in (r[1] or "")}
    assert planted == toxic
    clean = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in rows if r[0] not in toxic)

    one = stages["near_duplicates"](spark, clean, str(tmp_path)).cache()
    left = [(r.doc_id, r.text) for r in clean.collect()]
    want = {(d, t) for (d, t), (_, c) in zip(left, brute(left, 5, 80)) if d == c}
    assert one.columns == docs.columns and {(r.doc_id, r.text) for r in one.collect()} == want

    mix = stages["mixing"](spark, one, str(tmp_path)).cache()
    assert mix.columns == docs.columns
    size, taken = Counter(), Counter()
    for r in one.collect():
        size[r.source] += len((r.text or "").split())
    for r in mix.collect():
        taken[r.source] += len((r.text or "").split())
    for s, target in level_out(size).items():
        assert abs(taken[s] - target) <= 130
    assert all(n <= 2 for n in Counter((r.doc_id, r.text) for r in mix.collect()).values())

    pieces = stages["packing"](spark, mix, str(tmp_path)).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in mix.collect())
    used = Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 1024


def test_run_is_the_stages(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, docs.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_one_of_each_without_ids(spark, tmp_path):
    """Near copies without ids, or of one id, are one document."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text + " x"), (None, text + " y"), (None, "apart"), (4, "of " + text.upper()), (4, text.upper() + " end"), (4, ""), (None, None)]
    rows = [(d, t and (t if d is None else t.replace("W", "V"))) for d, t in rows]
    one = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), len(r.text or "") > 60) for r in one) == [("4", False), ("4", True), ("None", False), ("None", False), ("None", True)]


def test_clashing_columns_maps_and_empty_tables(spark, tmp_path):
    """Columns named as the stage's own, columns that have no order, and no rows at all."""
    schema = "doc_id long, text string, source string, id_ int, key_ string, times_ map<string,int>, component long, row_ string, `a.b` int"
    rows = [(1, "one two three four five six", "s", 1, "k", {"x": 1}, 7, "r", 2)] * 2 + [(2, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted((r.doc_id, r.id_, r["a.b"]) for r in kept.collect() if r.doc_id == 1) == [(1, 1, 2)] and kept.count() == 2
    mix = corpus_pipeline.mix_sources(spark, kept, str(tmp_path))
    assert mix.columns == docs.columns and mix.where("doc_id = 1").count() <= 2
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).count() == 3
