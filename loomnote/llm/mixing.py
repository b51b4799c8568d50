"""Mixing sources to target weights by pivotal dependent rounding, on DataFrame functions alone.

Every source has a target of words. A document of a source whose target is r times its words should be taken r
times on average: floor(r) whole copies and one more with probability p = r - floor(r). Independent draws would
scatter around the target; pivotal rounding does not. Two open documents a and b with the word masses p*size are
paired, and mass moves from one to the other, at random but without bias, until one of them is whole (taken or
not); the other stays open and meets the next. The sum of masses never changes, so a source ends within one
document of its target, while each document keeps its own probability.

The pairing is a reduction tree: documents are dealt into leaves of ``FAN`` on average by a hash, each leaf is
folded to one open document, and ``FAN`` leaves at a time are folded again. No task sees more than a few hundred
rows of a source, however large it is, and a level has a ``FAN``-th of the rows of the one before. Within a fold
large documents go first, so what is left over at the root is mostly small; it is rounded to the nearer side.
Draws are hashes of ids and texts, so reruns agree. Rows that are alike in both would share a leaf, however many they
are: the number of such a row among its like is part of its hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.llm.common import WORD, by_broadcast, staged

#: Open documents folded in one group.
FAN = 64
#: Sources up to this number are joined by broadcast (a row is under 200 bytes); more are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Repeated rows up to this number are joined by broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_REPEATS = 1_000_000


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to ``sources`` (source, source_size, n): weights by code point of the source, null last, repeating.

    A target stops at ``cap`` times its source's size, and what exceeds it is shared again by weight. That ends at
    the level L where the sum of min(cap*size, L*weight) is the wanted total: with sources ordered by cap*size/weight,
    L is the largest of (total - caps before) / (weights from here on).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, onward = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), k + 1)
    return (
        sources.withColumn("weight", w)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("target", F.least("most", F.max("level").over(everything) * F.col("weight")))
        .select("source", "source_size", "n", "target")
    )


def _folded(open_: DataFrame, seed: int) -> DataFrame:
    """One level: rows (source, leaf, h, row, w, m) folded by (source, leaf) to the open one and ``won``, the rows taken."""
    u = f"(pmod(xxhash64(s.h, b.h, {seed}L), 9007199254740992L) / 9007199254740992D)"
    up, down = "least(s.w - s.m, b.m)", "least(s.m, b.w - b.m)"
    goes_up = f"{u} * ({up} + {down}) < {down}"
    state = "named_struct('h', {x}.h, 'row', {x}.row, 'w', {x}.w, 'm', {m}, 'won', {won})"
    fold = f"""aggregate(slice(items, 2, size(items)), {state.format(x="items[0]", m="items[0].m", won="cast(array() as array<bigint>)")},
        (s, b) -> case
            when {goes_up} and s.w - s.m <= b.m then {state.format(x="b", m="b.m - (s.w - s.m)", won="array_append(s.won, s.row)")}
            when {goes_up} then {state.format(x="s", m="s.m + b.m", won="s.won")}
            when s.m <= b.w - b.m then {state.format(x="b", m="b.m + s.m", won="s.won")}
            else {state.format(x="s", m="s.m - (b.w - b.m)", won="array_append(s.won, b.row)")} end)"""
    items = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "h", "row", "w", "m"))).alias("items")
    return open_.groupBy("source", "leaf").agg(items).select("source", "leaf", F.expr(fold).alias("s")).select("source", "leaf", "s.*")


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with a hash of its own for each of several rows alike, which goes by its number among them.

    The number is that within the task that read the row, plus how many the tasks before have; rows that are alike can
    change places, so the same hashes come out however the table is cut.
    """
    repeats = staged(rows.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "repeats")
    alike = rows.join(by_broadcast(repeats, BROADCAST_REPEATS), "h").select("h", "row", F.shiftright("row", 33).alias("task"))
    inside = alike.withColumn("nth", F.row_number().over(Window.partitionBy("h", "task").orderBy("row")))
    before = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = alike.groupBy("h", "task").agg(F.count("*").alias("n")).select("h", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = staged(inside.join(bases, ["h", "task"]).select("row", (F.col("nth") + F.col("base")).alias("nth")), "numbered")
    rows = rows.join(by_broadcast(numbered, BROADCAST_REPEATS), "row", "left")
    return rows.withColumn("h", F.when(F.col("nth").isNotNull(), F.xxhash64("h", "nth")).otherwise(F.col("h"))).drop("nth")


def mix(
    df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col, size, source_size, target, copies, taken`` for each row: how often the mix takes it, and its words times that.

    ``size`` counts words (a null text has 0 and is taken floor(r) times, which takes no words). A null source is a
    source of its own. Null ids and repeated rows are rows as others. An empty table gives no rows. ``keep`` names
    columns to pass through, in a struct ``kept``.
    """
    spark = df.sparkSession
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    rows = staged(
        df.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("h"), F.greatest(size, F.lit(0)).alias("size"),
            F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
        ),
        "sizes",
    )
    rows = _told_apart(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    sources = staged(targets(sources, weights, share, cap), "targets")
    n_sources, n_most = sources.agg(F.count("*"), F.max("n")).first()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = sources.select(F.col("source").alias("name"), "source_size", "target", "n", ratio.alias("ratio"))
    known = F.broadcast(known) if n_sources <= BROADCAST_SOURCES else known
    rows = rows.join(known, rows["source"].eqNullSafe(known["name"]), "left").withColumn("whole", F.floor("ratio").cast("long"))

    part = F.col("ratio") - F.col("whole")
    open_ = rows.where((F.col("size") > 0) & (part > 0)).select(
        "source", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / FAN)).alias("leaf"), "h", "row", F.col("size").cast("double").alias("w"), (part * F.col("size")).alias("m")
    )
    won, leaves, level = [], max(1, -(-(n_most or 0) // FAN)), 0
    while True:
        folded = staged(_folded(open_, seed + level), f"fold{level}")
        won.append(folded.select(F.explode("won").alias("row")))
        if leaves == 1:
            won.append(folded.where(F.col("m") * 2 > F.col("w")).select("row"))
            break
        open_ = folded.select("source", F.floor(F.col("leaf") / FAN).alias("leaf"), "h", "row", "w", "m")
        leaves, level = -(-leaves // FAN), level + 1
    taken = won[0]
    for x in won[1:]:
        taken = taken.unionAll(x)
    copies = F.col("whole") + F.when(F.col("more").isNotNull(), 1).otherwise(0)
    return (
        rows.join(taken.select("row", F.lit(1).alias("more")), "row", "left")
        .withColumn("copies", copies)
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else [])
        )
    )


def mixed(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``df``, each as many times as it is taken. A row without words comes as often as the whole part of its source's ratio says."""
    out = mix(df, weights, share, cap, seed, id_col, text_col, source_col, keep=tuple(df.columns))
    return out.where("copies > 0").select("kept", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("kept.*")
