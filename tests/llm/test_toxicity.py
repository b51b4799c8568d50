import functools
import random

import numpy as np
import pytest

from loomnote.llm import toxicity
from loomnote.llm.toxicity import fit_chain, score, text_features, train, without_toxic

SCHEMA = "doc_id long, text string, scores string, c_text int"


def data(n, seed):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    out = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 200))
        poor, toxic = rng.random() < 0.4, False
        if poor:
            words += ["lorem", "click", "junk"]
            toxic = rng.random() < 0.5
        if toxic:
            words += [rng.choice(["vileling", "vilery", "nasty"]) for _ in range(2)]
        rng.shuffle(words)
        out.append((i, " ".join(words), int(poor), int(toxic)))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], "x", 1) for r in rows] + [(None, None, "x", 1), (-1, "", None, None), (-2, "long " * 20000, "", 0), (-2, "long " * 20000, "", 0)], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[: len(rows) // 2]] + [(None, 1, 1), (3, None, 1), (10**9, 1, 1)], "doc_id long, poor int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_rows(spark):
    rows = data(900, 1)
    docs, labels = tables(spark, rows)
    chain = train(docs, labels, ("poor", "toxic"))
    assert chain.models[1].chained and not chain.models[0].chained
    got = {r.doc_id: r for r in score(docs, chain).collect()}
    held_out = rows[len(rows) // 2 :]
    assert np.mean([(got[i].p_toxic >= 0.5) == bool(t) for i, _, _, t in held_out]) > 0.98
    assert np.mean([(got[i].p_poor >= 0.5) == bool(p) for i, _, p, _ in held_out]) > 0.98
    assert score(docs, chain).count() == docs.count()
    kept = without_toxic(docs, chain, "toxic")
    assert kept.schema == docs.schema
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect() if got[r.doc_id].p_toxic < 0.5)


def test_chain_uses_earlier_logits():
    """The second category is the first one: with few words of its own, the chained logit must carry it."""
    rng = random.Random(2)
    texts = [("mark " if rng.random() < 0.5 else "") + " ".join(rng.choices(["a1", "b2", "c3"], k=3)) for _ in range(400)]
    y = [[int("mark" in t)] * 2 for t in texts]
    chain = fit_chain([np.array(sorted(text_features(t)), "<u4") for t in texts], y, ("one", "two"))
    assert chain.models[1].chained[0] > 0
    assert all((chain.logits(text_features(t))[1] > 0) == bool(v[1]) for t, v in zip(texts, y))


def test_no_labels(spark):
    docs, labels = tables(spark, data(20, 3))
    for none in (labels.limit(0), labels.where("toxic = 7")):
        chain = train(docs, none, ("poor", "toxic"))
        assert all(r.p_toxic < 0.5 for r in score(docs, chain).collect())
    assert score(docs.limit(0), chain).count() == 0


def plain_fit(x, y, earlier, rows, most=toxicity.FEATURES):
    """A dense logistic regression by Newton's method, on the features that tell the classes of ``rows`` apart best; gives a function to logits."""
    n, rate = x[rows].sum(0), y[rows].mean()
    apart = np.abs(x[rows].T @ y[rows] - n * rate) / np.sqrt(n * rate * (1 - rate) + 1)
    apart[n < 3] = -1
    best = [j for j in np.argsort(-apart, kind="stable")[:most] if apart[j] > 1.5]
    design = lambda who: np.c_[x[who][:, best], np.clip(earlier[who], -8, 8) / 4, np.ones(len(who))]
    a, w = design(rows), np.zeros(len(best) + earlier.shape[1] + 1)
    penalty = np.r_[np.full(len(w) - 1, toxicity.L2), 0.0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(len(w)), a.T @ (p - y[rows]) + penalty * w)
    return lambda who: np.clip(design(np.asarray(who)) @ w, -8, 8)


def test_equals_a_plain_chain(monkeypatch):
    """The same folds, features and penalty, fitted densely to the end: probabilities agree."""
    monkeypatch.setattr(toxicity, "fit", functools.partial(toxicity.fit, steps=20_000))
    rows = data(150, 5)
    held = [np.array(sorted(text_features(r[1])), "<u4") for r in rows]
    names = np.unique(np.concatenate(held))
    x = np.zeros((len(rows), len(names)))
    for i, h in enumerate(held):
        x[i, np.searchsorted(names, h)] = 1
    y = np.array([r[2:] for r in rows], float)
    chain, everyone = fit_chain(held, y, ("poor", "toxic")), np.arange(len(rows))
    folds, earlier, logits = everyone % toxicity.FOLDS, np.zeros((len(rows), 0)), []
    for k in range(2):
        # Scoring feeds the logits of the whole models; training fed those of models that had not seen a row.
        whole = plain_fit(x, y[:, k], earlier, everyone)
        if k == 0:
            logits.append(whole(everyone))
            unseen = np.zeros(len(rows))
            for f in range(toxicity.FOLDS):
                unseen[folds == f] = plain_fit(x, y[:, 0], earlier, everyone[folds != f])(everyone[folds == f])
            earlier = unseen[:, None]
        else:
            earlier[:, 0] = logits[0]
            logits.append(whole(everyone))
    got = np.array([chain.logits(h.tolist()) for h in held])
    p = lambda z: 1 / (1 + np.exp(-z))
    assert np.abs(p(got) - p(np.stack(logits, 1))).max() < 1e-3


@pytest.mark.parametrize("sample", [4, 1000])
def test_repeated_ids_are_one_row(spark, sample, monkeypatch):
    """However often ids are repeated in texts or labels, no more than ``sample`` rows come to the driver."""
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, labels, categories: seen.append((len(rows), labels)))
    docs = spark.createDataFrame([(i % 6, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 6, i // 6 % 2, 1) for i in range(30)], "doc_id long, poor int, toxic int")
    train(docs, labels, ("poor", "toxic"), sample=sample)
    assert seen == [(min(sample, 6), [[0, 1]] * min(sample, 6))]
