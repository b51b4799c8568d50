import random

import pytest

from loomnote.llm import chosen_path
from loomnote.llm.chosen_path import near_duplicates
from loomnote.llm.components import connected
from loomnote.sources.staging import ready_to_cut

SCHEMA = "doc_id long, text string, key string, n int, tokens int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sets(text, k):
    words = lower(text or "").encode().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, least):
    """Size and least reachable id of each row, over all pairs."""
    held = [sets(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, a in enumerate(held):
        for j in range(i):
            both = len(a & held[j])
            if a and held[j] and 100 * both >= least * (len(a) + len(held[j]) - both):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    return [(len(held[i]), lowest.get(find(i)) if held[i] else rows[i][0]) for i in range(len(rows))]


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [None, "", "  ", "one", "One", "one two", "one  TWO", "ß é", "ß É", "long text " * 20000]
    for size in (1,) * 60 + (2,) * 10 + (5, 12, 90):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    template = [word() for _ in range(60)]
    rows += [" ".join(template + [word() for _ in range(rng.randint(2, 30))]) for _ in range(70)]
    rng.shuffle(rows)
    ids = rng.sample(range(10**6), len(rows))
    return list(zip(ids, rows))


def check(spark, rows, k, least=80):
    df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(df, k, least).collect())
    want = sorted((str(d), n, str(c), d == c) for (d, _), (n, c) in zip(rows, brute(rows, k, least)))
    assert got == want


@pytest.mark.parametrize("k", [2, 5])
def test_equals_all_pairs(spark, k):
    check(spark, corpus(k), k)


def test_large_nodes(spark, monkeypatch):
    """With tiny nodes, pivots, blocks and depth all come into play."""
    for name, value in (("SMALL", 3), ("PIVOTS", 2), ("BLOCK", 4), ("DEPTH", 3), ("BROADCAST_CLASSES", 0)):
        monkeypatch.setattr(chosen_path, name, value)
    check(spark, corpus(7), 2)


def test_crowded_nodes_go_on_down(spark, monkeypatch):
    """Members left at DEPTH meet their whole node only where it is no crowd: texts that share a part, and some of which have a near copy."""
    for name, value in (("SMALL", 3), ("PIVOTS", 2), ("DEPTH", 1), ("CROWD", 12)):
        monkeypatch.setattr(chosen_path, name, value, raising=False)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(40)]
    texts = [" ".join(shared + [word() for _ in range(60)]) for _ in range(60)]
    texts += [t + " more" for t in texts[::4]]
    met, real = [], chosen_path.candidates

    def candidates(classes, least):
        out = real(classes, least)
        met.extend(out[1].where("meets and not near").join(out[1].groupBy("node").count(), "node").select("count").collect())
        return out

    monkeypatch.setattr(chosen_path, "candidates", candidates)
    check(spark, list(enumerate(texts)), 2)
    assert met and max(r["count"] for r in met) <= 12


def test_few_rows_that_meet_a_large_node_are_one_block(spark):
    rows = spark.range(2000).selectExpr("1L node", "id key", "id < 5 meets")
    sizes = chosen_path._sides(rows, "meets", "true")
    assert chosen_path._blocks(rows, "meets", "true", sizes, "key").count() == 16  # 5 rows with 16 blocks; once 5 or so with 16 each


def bridged(seed, size=70):
    """Two families at a likeness of 0.68, and for each a document that lacks half of what is its family's alone: these two are linked, and nothing else is across."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared, texts = [word() for _ in range(200)], []
    for _ in range(2):
        first, second = ([word() for _ in range(23)] for _ in range(2))
        texts.append(" ".join(shared + first))
        texts += [" ".join(shared + first + second + [word() for _ in range(3)]) for _ in range(size)]
    return texts


def test_settled_members_of_two_components_meet(spark):
    """In these seeds the two that are linked share large nodes only, in which pivots of their own families settle them."""
    check(spark, list(enumerate(t for seed in (2, 27, 41) for t in bridged(seed))), 2)


def test_plans_and_their_shuffles_go_between_steps(spark):
    import time

    def held():
        return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in corpus(7)[:60]], SCHEMA)
    first = spark.sparkContext._jsc.sc().newShuffleId()
    near_duplicates(df, 2)
    made = spark.sparkContext._jsc.sc().newShuffleId() - first
    end = time.time() + 20
    while held() > made / 2 and time.time() < end:  # Spark's cleaner works behind
        time.sleep(0.5)
    assert made > 20 and held() <= made / 2


def test_edges_of_tables(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (None, "x y"), (None, "x y"), (9, "q"), (9, "r s t"), (9, "q"), (7, None)]
    check(spark, rows, 2)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, None), (2, "")], 2)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000 + rng.randrange(60), 5000 + rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    ready_to_cut(spark)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
