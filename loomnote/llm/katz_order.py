"""Katz backoff of any order as joins of tables, one table of n-grams and one of histories per order.

    P_k(w | h) = d_k(c) * f(h) * c(h, w) / c(h)     if the n-gram was seen,
                 a(h) * P_{k-1}(w | h without its first word)   else; a(h) is 1 where h was never seen,

evaluated from the highest order down, for each token. P_1 is that of ``katz``, and so are the discounts, taken for each order
from its own counts of counts; a(h) makes the probabilities after h sum to exactly 1. This is the plain form of what
``katz`` does for bigrams with packed arrays: it moves every token once for each order, which takes several times the disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnote.llm.common import WORD, ascii_lower, staged
from loomnote.llm.grams import let
from loomnote.llm.katz import KATZ, Unigrams, discounts

#: What stands for the end of a text and for what is before its start: no word hashes to them but by chance.
END, START = -1, -2


def _tokens(df: DataFrame, order: int, id_col: str, text_col: str) -> DataFrame:
    """``row, train, w, h2 ... h<order>``: every token with its histories, as hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held_out = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(10)) == 0
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out.alias("held_out"), F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)).alias("words"))
    before = lambda j: f"if(i < {j}, {START}L, get(t, i - {j}))"
    histories = ", ".join(f"'h{k}', xxhash64({', '.join(before(j) for j in range(1, k))})" for k in range(2, order + 1))
    each = let("t", f"concat(transform(words, w -> xxhash64(w)), array({END}L))", f"transform(t, (w, i) -> named_struct('w', w, {histories}))")
    return rows.select("row", "id", "held_out", F.explode(F.expr(each)).alias("x")).select("row", "id", (~F.col("held_out")).alias("train"), "x.*")


def _discounted(d: list[float]):
    rate = F.lit(1.0)
    for r, x in enumerate(d, 1):
        rate = F.when(F.col("c") == r, F.lit(x)).otherwise(rate)
    return rate


def _rates(counts: DataFrame) -> list[float]:
    """The discounts from the counts of counts of a table with ``c``."""
    low = {r["c"]: r["n"] for r in counts.where(F.col("c") <= KATZ + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}  # at most KATZ + 1 rows
    return discounts([0, *(low.get(r, 0) for r in range(1, KATZ + 2))])


def score(df: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``katz.score``, for n-grams of up to ``order`` words (2 at least)."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    tokens = staged(_tokens(df, order, id_col, text_col), "tokens")
    train = tokens.where("train")
    words = staged(train.groupBy("w").agg(F.count("*").alias("c")), "unigrams")
    n, v, *low = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *(F.count(F.when(F.col("c") == r, 1)) for r in range(1, KATZ + 2))).first()
    uni = Unigrams(n, v, 0, [0, *low])
    lower = words.select("w", "c", (_discounted(uni.d) * F.col("c") * uni.scale / max(1, n)).alias("p1"))

    scored = tokens.join(lower, "w", "left").withColumn("p", F.coalesce("p1", F.lit(uni.unknown))).withColumn("known", F.coalesce("c", F.lit(0))).drop("c", "p1")
    below, below_keys = lower.select("w", F.col("p1").alias("q")), ["w"]
    for k in range(2, order + 1):
        h, keys = f"h{k}", [f"h{k}", "w"]
        counted = train.groupBy(*dict.fromkeys([*keys, *below_keys])).agg(F.count("*").alias("c"))
        counts = staged(counted.join(below, below_keys), f"ngrams{k}")  # what was seen after h was seen after less of it
        d = _rates(counts)
        held = counts.groupBy(h).agg(F.sum("c").alias("total"), F.sum(F.col("c") * (1 - _discounted(d))).alias("spared"), F.sum("q").alias("seen"))
        # A history whose counts are all above KATZ leaves nothing: all its counts then give up one in c(h) + 1.
        spares = F.col("spared") > 0
        free = F.when(spares, F.col("spared") / F.col("total")).otherwise(1 / (F.col("total") + 1))
        factor = F.when(spares, 1.0).otherwise(F.col("total") / (F.col("total") + 1))
        held = staged(held.select(h, "total", factor.alias("factor"), (free / F.greatest(1 - F.col("seen"), F.lit(1e-300))).alias("alpha")), f"histories{k}")
        level = staged(counts.join(held, h).select(*keys, (_discounted(d) * F.col("factor") * F.col("c") / F.col("total")).alias("q")), f"level{k}")
        scored = scored.join(level, keys, "left").join(held.select(h, "alpha"), h, "left")
        scored = scored.withColumn("p", F.coalesce("q", F.coalesce("alpha", F.lit(1.0)) * F.col("p"))).drop("q", "alpha")
        below, below_keys = level, keys
    base = F.log10((F.col("known") + 0.1) / (n + 0.1 * (v + 1)))
    out = scored.groupBy("row").agg(
        F.first("id").alias(id_col), (~F.first("train")).alias("held_out"), F.count("*").alias("n_tokens"), F.count(F.when(F.col("known") > 0, 1)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), F.sum(base).alias("base_score"), F.sum(F.log10("p")).alias("score"),
    )
    return out.drop("row")
