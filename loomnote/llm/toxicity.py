"""Toxicity by a classifier chain: categories one after the other, each a linear model on words and on earlier categories.

The first category's model sees word features alone. Each later one also sees the logits of those before it. To
train it on what it will meet, earlier logits of training rows come from models that did not see them (out of
fold); the models that score are then fitted on all training rows.

Features are a text's distinct words and their first 4, 5 and 6 letters, hashed to 32 bits. A fit keeps the
``FEATURES`` that tell the classes apart best. Training takes at most ``SAMPLE`` labelled rows, those with the least
hash of their id; labels beyond it are not needed for weights. Scoring reads every row in one narrow pass.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that training takes, features of a fit, folds, and words whose features a worker remembers.
SAMPLE, FEATURES, FOLDS, REMEMBERED = 4_000, 3_000, 5, 200_000
#: The penalty on squared weights, and steps of a fit.
L2, STEPS = 0.1, 150

_WORDS = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    n = len(word)
    parts = {f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if k <= n)}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in parts]


def text_features(text: str) -> set[int]:
    return {f for w in set(_WORDS.findall(text.lower())) for f in word_features(w)}


@dataclass
class Linear:
    """``bias + weights of the features present + chained @ earlier logits``."""

    weights: dict[int, float]
    bias: float
    chained: tuple[float, ...] = ()

    def logit(self, features, earlier=()) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features) + sum(a * b for a, b in zip(self.chained, earlier))


class Sample:
    """Training rows by number: which features each has, without those that fewer than 3 rows have."""

    def __init__(self, rows):
        import numpy as np

        every = np.concatenate(rows) if len(rows) else np.empty(0, "u4")
        every.sort()
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, "i8")
        names = every[first][np.diff(np.r_[first, len(every)]) >= 3]
        del every, first
        owner, col = [], []
        for i, row in enumerate(rows):
            place = np.searchsorted(names, row)
            place = place[(place < len(names)) & (names[np.minimum(place, len(names) - 1)] == row)] if len(names) else place[:0]
            owner.append(np.full(len(place), i, "i4"))
            col.append(place.astype("i4"))
        self.names, self.n = names, len(rows)
        self.owner, self.col = (np.concatenate(x) if x else np.empty(0, "i4") for x in (owner, col))

    def without(self, out):
        """This sample with the rows in the mask ``out`` emptied."""
        import copy

        other, kept = copy.copy(self), ~out[self.owner]
        other.owner, other.col = self.owner[kept], self.col[kept]
        return other

    def selected(self, y, rate: float, most: int):
        """The features with the largest standardised difference between the classes: their names, and (row, feature) pairs."""
        import numpy as np

        n = np.bincount(self.col, minlength=len(self.names))
        positive = np.bincount(self.col, weights=y[self.owner], minlength=len(self.names))
        score = np.abs(positive - n * rate) / np.sqrt(n * rate * (1 - rate) + 1)
        score[n < 3] = -1
        best = np.argsort(-score, kind="stable")[:most]
        kept = np.sort(best[score[best] > 1.5])
        place = np.full(len(self.names), -1)
        place[kept] = np.arange(len(kept))
        col = place[self.col]
        return self.names[kept], self.owner[col >= 0], col[col >= 0]


def fit(sample: Sample, y, earlier, out=None, l2: float = L2, steps: int = STEPS) -> Linear:
    """Logistic regression by accelerated gradient descent, without the rows in the mask ``out``; ``earlier`` are the chained logits."""
    import numpy as np

    n, y = sample.n, np.asarray(y, float)
    seen = np.ones(n) if out is None else (~out).astype(float)
    rate = float((y * seen).sum() / max(1.0, seen.sum()))
    if rate in (0.0, 1.0):
        p = ((y * seen).sum() + 0.5) / (seen.sum() + 2)
        return Linear({}, math.log(p / (1 - p)), (0.0,) * earlier.shape[1])
    sample = sample if out is None else sample.without(out)
    names, owner, col = sample.selected(y, rate, FEATURES)
    d, c = len(names), earlier.shape[1]
    chain = np.clip(earlier, -8, 8) / 4
    w, v, bias = np.zeros(d + c + 1), np.zeros(d + c + 1), d + c
    w[bias] = v[bias] = math.log(rate / (1 - rate))
    reg = np.r_[np.full(d + c, l2), 0.0]
    norm = np.bincount(owner, minlength=n).astype(float) + (chain**2).sum(1) + 1
    # Newton-like scale for each coordinate keeps the steps stable without a line search.
    scale = np.r_[np.bincount(col, weights=norm[owner], minlength=d), (np.abs(chain) * np.sqrt(norm)[:, None]).sum(0) + 1e-9, norm.sum()] * 0.25 / np.sqrt(norm.max()) + reg
    scale = np.maximum(scale, 1e-3)
    momentum = 1.0
    for _ in range(steps):
        z = np.bincount(owner, weights=v[col], minlength=n) + chain @ v[d : d + c] + v[bias]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g *= seen
        grad = np.r_[np.bincount(col, weights=g[owner], minlength=d), chain.T @ g, g.sum()] + reg * v
        new = v - grad / scale
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        if (grad * (new - w)).sum() > 0:  # restart when the momentum points uphill
            following, momentum = 1.0, 1.0
        v = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return Linear(dict(zip(names.tolist(), w[:d].tolist())), float(w[bias]), tuple((w[d : d + c] / 4).tolist()))


def _clip(x: float) -> float:
    return max(-8.0, min(8.0, x))


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: tuple[Linear, ...]

    def logits(self, features) -> list[float]:
        out: list[float] = []
        for m in self.models:
            out.append(_clip(m.logit(features, out)))
        return out


def fit_chain(rows, labels, categories: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """Fit the categories in order; ``labels`` has a column for each. Folds go by row number, so reruns agree."""
    import numpy as np

    labels = np.asarray(labels, float).reshape(len(rows), len(categories))
    fold, sample = np.arange(len(rows)) % folds, Sample(rows)
    earlier, models = np.zeros((len(rows), 0)), []
    for k in range(len(categories)):
        models.append(fit(sample, labels[:, k], earlier))
        if k + 1 < len(categories):
            unseen = np.zeros(len(rows))
            for f in range(folds):
                m = fit(sample, labels[:, k], earlier, out=fold == f)
                for i in np.flatnonzero(fold == f):
                    unseen[i] = _clip(m.logit(rows[i].tolist(), earlier[i]))
            earlier = np.c_[earlier, unseen]
    return Chain(categories, tuple(models))


def train(df: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit a chain on at most ``sample`` rows of ``labels`` (id and a 0/1 column for each category) that ``df`` has.

    Label rows with a null id or category are left out; of several for one id the least counts, and of several texts of
    one id one. Without labelled rows every model says "no".
    """
    import numpy as np

    ys = [f"y{i}" for i in range(len(categories))]
    known = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(y) for c, y in zip(categories, ys))).dropna()
    known = known.groupBy("id").agg(F.min(F.struct(*ys)).alias("y")).select("id", "y.*")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.array(sorted(text_features(t or "")), "<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary()), *b.columns[2:]], names=["id", "held", *b.schema.names[2:]])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # ``chosen`` has at most ``sample`` narrow rows, a fixed bound; grouped by id, so has what comes to the driver.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", *ys)
    kind = df.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(featured, f"id {kind}, held binary, {', '.join(f'{y} int' for y in ys)}")
    got = sorted(found.groupBy("id").agg(F.min(F.struct("held", *ys)).alias("x")).select("id", "x.*").collect())
    return fit_chain([np.frombuffer(r.held, "<u4") for r in got], [[r[y] for y in ys] for r in got], categories)


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id_col`` and ``p_<category>`` for each row, or with ``keep`` all columns, as c0, c1, ..., and ``scores``, an array in their order.

    A null or empty text has no features: it gets the models' base rates.
    """
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    wanted = {f for m in chain.models for f in m.weights}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, ...]] = {}

        def features(word: str) -> tuple[int, ...]:
            found = held.get(word)
            if found is None:
                if len(held) >= REMEMBERED:
                    held.clear()
                found = held[word] = tuple(f for f in word_features(word) if f in wanted)
            return found

        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                present = set().union(*map(features, set(_WORDS.findall((t or "").lower()))))
                out.append([1 / (1 + math.exp(-x)) for x in chain.logits(sorted(present))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, "scores"]) if keep else pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "scores"])

    if keep:
        fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]  # so that "scores" clashes with none
        at = df.columns.index(text_col)
        rows = df.toDF(*(f.name for f in fields))
        return rows.mapInArrow(scored, StructType([*fields, StructField("scores", ArrayType(DoubleType()))]))
    at = 1
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(scored, f"id {df.schema[id_col].dataType.simpleString()}, scores array<double>")
    return out.select(F.col("id").alias(id_col), *(F.col("scores")[i].alias(f"p_{c}") for i, c in enumerate(chain.categories)))


def without_toxic(df: DataFrame, chain: Chain, category: str, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, as they are, whose ``category`` has a probability below ``threshold``."""
    k = chain.categories.index(category)
    kept = score(df, chain, id_col, text_col, keep=True).where(F.col("scores")[k] < threshold)
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))
