import functools
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from loomnote.llm import katz, katz_order
from loomnote.llm.katz import KATZ, discounts, score

SCHEMA = "doc_id long, text string, score string, block int, part int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


class Plain:
    """The model over dictionaries, token by token."""

    def __init__(self, texts):
        self.uni, self.bi, self.hist = Counter(), Counter(), Counter()
        for t in texts:
            seq = ["<s>", *t]
            self.uni.update(t)
            self.bi.update(zip(seq, t))
            self.hist.update(seq[:-1])
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d1 = discounts([0, *(sum(c == r for c in self.uni.values()) for r in range(1, KATZ + 2))])
        self.d2 = discounts([0, *(sum(c == r for c in self.bi.values()) for r in range(1, KATZ + 2))])
        self.after = {}
        for (h, w), c in self.bi.items():
            self.after.setdefault(h, {})[w] = c

    @staticmethod
    def cut(c, d):
        return c * (d[c - 1] if c <= KATZ else 1.0)

    def p1(self, w):
        low = sum(c - self.cut(c, self.d1) for c in self.uni.values())
        if not self.n:
            return 1.0
        scale, rest = (1.0, low / self.n) if low > 0 else (self.n / (self.n + 1), 1 / (self.n + 1))
        return self.cut(self.uni[w], self.d1) * scale / self.n if self.uni[w] else rest

    def p2(self, w, h):
        seen = self.after.get(h)
        if not seen:
            return self.p1(w)
        total = sum(seen.values())
        spared = sum(c - self.cut(c, self.d2) for c in seen.values())
        factor, free = (1.0, spared / total) if spared > 0 else (total / (total + 1), 1 / (total + 1))
        if w in seen:
            return self.cut(seen[w], self.d2) * factor / total
        return free / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)


def corpus(n=160):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "ONLY\x0bhere É é"), (n + 3, "w1 " * 3000), (n + 3, "w1 w2"), (n + 3, "w1 w2"), (None, "w1 w2 never")]
    return rows


@pytest.mark.parametrize("spread,block", [(katz.SPREAD, katz.BLOCK_TOKENS), (40, 500)])
def test_equals_plain_model(spark, monkeypatch, spread, block):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    rows = corpus()
    tokens = lambda t: [x.decode() for x in lower(t or "").encode().split()] + ["</s>"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    m = Plain([tokens(t) for d, t in rows if not held(d)])
    want = []
    for d, t in rows:
        seq = tokens(t)
        base = sum(math.log10((m.uni[w] + 0.1) / (m.n + 0.1 * (m.v + 1))) for w in seq)
        s = sum(math.log10(m.p2(w, h)) for h, w in zip(["<s>", *seq], seq))
        want.append((str(d), held(d), len(seq), sum(m.uni[w] > 0 for w in seq), m.n, base, s))
    # a small ``spread`` is raised to tokens // (4 * parts) by the operator
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score(spark.createDataFrame([(*r, "", 1, 2) for r in rows], SCHEMA), spread=spread).collect()]
    assert [x[:5] for x in sorted(got)] == [x[:5] for x in sorted(want)]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_plain_model_is_normalised():
    m = Plain([lower(t or "").split() + ["</s>"] for _, t in corpus()])
    every = [*m.uni, "<unk>"]
    assert sum(map(m.p1, every)) == pytest.approx(1)
    for h in ["<s>", "w1", "w2", *list(m.after)[:60]]:
        assert sum(m.p2(w, h) for w in every) == pytest.approx(1)


def test_no_training_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = score(spark.createDataFrame([(held, "a b", "", 1, 2)], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(3, 0, 0, 0.0)]
    assert score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for a in ([np.array([], "u4"), np.array([0], "u2")], [rng.integers(0, 2**63, 1000, dtype="u8"), rng.integers(0, 70000, 5, dtype="u4")]):
        assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, katz._unpack(katz._pack(*a))))


def bigrams_of_blocks(count_of, blocks=3, n=30_000, words=1_000):
    """Packed bigrams of one part, and the rows they are made of: history, word, document."""
    rng, packed, rows = np.random.default_rng(5), [], []
    for _ in range(blocks):
        h, w, doc = rng.integers(0, 300, n), rng.integers(0, words, n), np.sort(rng.integers(0, 900, n))
        w[:3], h[3:5] = katz.UNKNOWN, katz.START
        key = h.astype("u8") << np.uint64(32) | w.astype("u8")
        order = np.argsort(key, kind="stable")
        key, doc, w, h = key[order], doc[order].astype("u2"), w[order], h[order]
        packed.append(katz._pack_bigrams(key, doc, count_of[np.minimum(w, words)], 7 + h.astype("u8")))
        rows.append((key, doc))
    return packed, rows


def test_bigrams_round_trip_and_write_a_word_count_once():
    rng = np.random.default_rng(2)
    varied, flat = np.r_[rng.integers(1, 2**24, 1_000), 0].astype("u8"), np.r_[np.ones(1_000), 0].astype("u8")
    packed, rows = bigrams_of_blocks(varied)
    same, _ = bigrams_of_blocks(flat)
    trained = [500] * len(packed)
    part, plain = katz._Part.merged(trained, packed), katz._Part.merged(trained, same)
    # 1,000 counts of 3 bytes a block, not one for each of about 28,000 bigrams
    assert all(len(a) - len(b) < 8_000 for a, b in [*zip(packed, same), (part.packed(), plain.packed())])

    want = Counter()
    for key, doc in rows:
        want.update(key[doc < 500].tolist())
    assert part.key.tolist() == sorted(set(np.concatenate([k for k, _ in rows]).tolist()))
    assert part.count.tolist() == [want[k] for k in part.key.tolist()]
    word = part.key & np.uint64(0xFFFFFFFF)
    assert (part.word_count == varied[np.minimum(word, 1_000)]).all() and (part.history_count == 7 + (part.key >> np.uint64(32))).all()
    back = katz._Part.unpacked(part.packed())
    for name in ("key", "word_count", "history_count", "count", "sizes", "place", "times", "docs", "first", "h", "group"):
        assert (getattr(back, name) == getattr(part, name)).all(), name
    at = done = 0
    for (key, doc), n in zip(rows, part.sizes.tolist()):
        times = back.times[at : at + n]
        assert (np.repeat(back.key[back.place[at : at + n]], times) == key).all() and (back.docs[done : done + len(doc)] == doc).all()
        at, done = at + n, done + len(doc)


def test_dictionaries_are_gone_before_bigrams_are_written(spark, monkeypatch):
    real, left = katz.staged, {}

    def staged(df, name, *partition_by):
        table = real(df, name, *partition_by)
        left[name] = [n for n, at in places.items() if any(Path(at.removeprefix("file:")).rglob("*.parquet"))]
        places[name] = table.staged_at
        if name == "blocks":
            places["words"] = f"{table.staged_at}/holds=words"
        return table

    places = {}
    monkeypatch.setattr(katz, "staged", staged)
    score(spark.createDataFrame([(*r, "", 1, 2) for r in corpus(40)], SCHEMA))
    assert left == {"blocks": [], "dictionary": ["blocks", "words"], "bigrams": ["blocks", "dictionary"], "spread": ["bigrams"]}


class PlainOrder(Plain):
    """The model of any order, by recursion over dictionaries."""

    def __init__(self, texts, order):
        super().__init__(texts)
        self.order, self.next, self.d = order, {}, {}
        for k in range(2, order + 1):
            counts = Counter()
            for t in texts:
                seq = ["<s>"] * (k - 1) + t
                counts.update(tuple(seq[i : i + k]) for i in range(len(t)))
            self.d[k] = discounts([0, *(sum(c == r for c in counts.values()) for r in range(1, KATZ + 2))])
            for g, c in counts.items():
                self.next.setdefault(g[:-1], {})[g[-1]] = c

    def p(self, w, h):
        if not h:
            return self.p1(w)
        seen = self.next.get(h)
        if not seen:
            return self.p(w, h[1:])
        d, total = self.d[len(h) + 1], sum(seen.values())
        spared = sum(c - self.cut(c, d) for c in seen.values())
        factor, free = (1.0, spared / total) if spared > 0 else (total / (total + 1), 1 / (total + 1))
        return self.cut(seen[w], d) * factor / total if w in seen else free / (1 - sum(self.p(x, h[1:]) for x in seen)) * self.p(w, h[1:])


@pytest.mark.parametrize("order", [2, 3])
def test_any_order_equals_recursion(spark, order):
    rows = corpus(70)
    tokens = lambda t: [x.decode() for x in lower(t or "").encode().split()] + ["</s>"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    m, want = PlainOrder([tokens(t) for d, t in rows if not held(d)], order), []
    m.p1 = functools.cache(m.p1)
    m.p = functools.cache(m.p)
    for d, t in rows:
        seq = tokens(t)
        padded = ["<s>"] * (order - 1) + seq
        want.append((str(d), held(d), len(seq), sum(m.uni[w] > 0 for w in seq), m.n, sum(math.log10(m.p(w, tuple(padded[i : i + order - 1]))) for i, w in enumerate(seq))))
    df = spark.createDataFrame([(*r, "", 1, 2) for r in rows], SCHEMA)
    for found in (katz_order.score(df, order), score(df, order=order)):
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in found.collect())
        assert [x[:5] for x in got] == [x[:5] for x in sorted(want)]
        assert [x[5] for x in got] == pytest.approx([x[5] for x in sorted(want)], rel=1e-9)
    for h in [("<s>",) * (order - 1), *list(m.next)[:40]]:
        assert sum(m.p(w, h) for w in [*m.uni, "<unk>"]) == pytest.approx(1)
