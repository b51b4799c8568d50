import hashlib
import random
import re

from loomnote.llm.winnowing import RANGE, compare_edited, fingerprints, read

SCHEMA = "doc_id long, text string, next string, f int, place_ int"


def winnow(hashes, w):
    """Positions chosen window by window: least, rightmost of the least."""
    w = min(w, len(hashes))
    return sorted({max(range(s, s + w), key=lambda i: (-hashes[i], i)) for s in range(len(hashes) - w + 1)}) if hashes else []


def texts():
    rng = random.Random(3)
    words = ["a", "b", "cé", "word", "ß"]
    out = [None, "", " ", "one", "one two three", "x" * 5000, "tie " * 300]
    out += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(120)]
    return out + out[-5:]


def test_chosen_positions(spark):
    k, w = 2, 4
    data = texts()
    rows = fingerprints(spark.createDataFrame([(i, t, "", 1, 2) for i, t in enumerate(data)], SCHEMA), k, w).collect()
    hashes = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]{1,16}", data[r.doc_id] or "")
        grams = [tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, bool(words)))]
        for p in r.fingerprint:
            assert hashes.setdefault(grams[p.position], p.hash) == p.hash
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]{1,16}", data[r.doc_id] or "")
        grams = [tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, bool(words)))]
        if all(g in hashes for g in grams):
            assert [p.position for p in r.fingerprint] == winnow([hashes[g] for g in grams], w)
        assert bool(r.fingerprint) == bool(words)


def test_passages_are_found(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(12)
    a, b = [" ".join(fresh(40) + shared + fresh(30)) for _ in range(2)]
    rows = fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    one, two = ({p.hash for p in r.fingerprint} for r in rows)
    assert one & two


def likeness(a, b):
    a, b = ({h for h, _ in read(x)} for x in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(data):
    for i, t in enumerate(data):
        n = len(t) // 2
        yield t[: len(t) - n] + data[(i + 1) % len(data)][:n]


def test_compare_edited(spark):
    for data in (texts(), texts() * 12, ["alone in the table with some words"]):
        rows = [(3 * i + 5, t, "", 1, 2) for i, t in enumerate(data)]
        got = sorted(compare_edited(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
        plain = [t or "" for t in data]
        assert len(data) < RANGE or len(data) > 2 * RANGE
        assert [r.doc_id for r in got] == [r[0] for r in rows]
        assert [r.n_chars for r in got] == [len(t) for t in plain]
        want = list(edited(plain))
        assert [r.edited_sha256 for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in want]
        prints = {}
        for t, r in zip(plain, got):
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        for t, r in zip(want, got):
            assert prints.setdefault(t, r.edited_fingerprint) == r.edited_fingerprint
        for i, r in enumerate(got):
            assert abs(r.near_next - likeness(r.fingerprint, got[(i + 1) % len(got)].fingerprint)) < 1e-12
            assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        # What is written is the fingerprint, hashes and positions.
        known = {r.doc_id: [(p.hash, p.position) for p in r.fingerprint] for r in fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert all(read(r.fingerprint) == known[r.doc_id] for r in got)


def test_null_and_repeated_ids(spark):
    rows = [(None, "first text", "", 1, 2), (4, "b", "", 1, 2), (4, "a", "", 1, 2), (9, None, "", 1, 2)]
    got = {(r.doc_id, r.n_chars): r.edited_sha256 for r in compare_edited(spark.createDataFrame(rows, SCHEMA)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(None, 10): sha("firsta"), (4, 1): sha("b"), (9, 0): sha("")} | {(4, 1): got[4, 1]}
    assert compare_edited(spark.createDataFrame([], SCHEMA)).count() == 0
