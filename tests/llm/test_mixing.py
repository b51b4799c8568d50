import re
from collections import defaultdict

import pytest

from loomnote.llm.mixing import mix, mixed

SCHEMA = "doc_id long, text string, source string, size int, row string"


def level_out(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by sharing the excess again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not above:
            target |= {s: level * w[s] for s in open_}
            break
        for s in above:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def table(n=4000):
    rows = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else [None, "b", "c", "é", "Z", "z"][i % 6]
        rows.append((i, " ".join(["w"] * (1 + i * 7919 % 97)), s, 5, "x"))
    rows += [(None, "one two", "b", 0, ""), (n, None, "b", 0, ""), (n + 1, "", "c", 0, ""), (7, rows[7][1], rows[7][2], 5, "x"), (n + 2, None, "empty", 1, ""), (n + 3, "big\v " * 3000, "c", 1, "")]
    return rows


def test_mix(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, n = defaultdict(int), defaultdict(int), {}
    where = {r[0]: r for r in rows}
    for r in rows:
        n[r[0]] = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        sizes[r[2]] += n[r[0]]
    want = level_out(sizes)
    for r in got:
        s = where[r.doc_id][2]
        assert r.size == n[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (100 if s != "c" else 3000)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))
    again = mixed(df)
    assert again.columns == df.columns
    assert again.count() == sum(r.copies for r in got)


def test_mix_is_unbiased(spark):
    df = spark.createDataFrame([(i, " ".join("w" * (1 + i % 9)), "a" if i < 60 else "b") for i in range(90)], "doc_id long, text string, source string")
    total, runs = defaultdict(float), 24
    for seed in range(runs):
        for r in mix(df, weights=(1, 1), share=0.7, seed=100 * seed).collect():
            total[r.doc_id] += r.copies / runs
            ratio = r.target / r.source_size
    a = [total[i] for i in range(60)]
    assert abs(sum(a) / 60 - min(2, ratio)) < 2 and max(a) < 1 and min(a) > 0
    small, large = [total[i] for i in range(60) if i % 9 < 3], [total[i] for i in range(60) if i % 9 > 5]
    assert abs(sum(small) / len(small) - sum(large) / len(large)) < 0.1


def test_mix_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix(spark.createDataFrame([(1, None, None, 1, "")], SCHEMA)).collect()[0].taken == 0


def test_repeated_rows_are_dealt_out(spark, monkeypatch):
    """A third of all rows alike, with ids or without: leaves stay small, and targets are met."""
    from loomnote.llm import mixing

    sizes, fold = [], mixing._folded
    monkeypatch.setattr(mixing, "_folded", lambda open_, seed: sizes.append(open_.groupBy("source", "leaf").count().agg({"count": "max"}).first()[0]) or fold(open_, seed))
    rows = [(None if i % 2 else 5, "the same words", "a", 1, "") for i in range(3000)] + [(i, "w " * (1 + i % 50), "ab"[i % 2], 1, "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df, weights=(2, 1), share=0.8).collect()
    assert max(sizes) < 4 * mixing.FAN
    for target, taken in {(r.target, sum(x.taken for x in got if x.target == r.target)) for r in got}:
        assert abs(target - taken) <= 50
