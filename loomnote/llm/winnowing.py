"""Document fingerprints by winnowing, on SQL functions alone.

A text is cut into words (a run of over ``WORD_MOST`` characters counts as several, so that text without spaces
has grams too). Of the hashes of all runs of k words, each window of w keeps its least, the rightmost where several
are least, with its position. Any passage of w + k - 1 words that two texts share leaves a hash in both.

A position is kept exactly if the run around it, back over hashes not smaller and on over hashes greater, is as
long as a window: that needs its neighbours only, not a minimum per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomnote.llm.grams import let, rolling

#: Characters of one word.
WORD_MOST = 16
#: Documents that a range of ids holds on average, and the most ranges.
RANGE, RANGES = 512, 65_536


def fingerprint_expr(text: str, k: int = 5, w: int = 8) -> str:
    """The fingerprint of the SQL expression ``text``: an array of hash << 32 | position, by position."""
    words = f"regexp_extract_all({text}, r'[^\\x20\\x09-\\x0D]{{1,{WORD_MOST}}}', 0)"
    back = " ".join(f"when coalesce(get(g, j - {d}), -1L) < x then {d - 1}" for d in range(1, w))
    on = " ".join(f"when coalesce(get(g, j + {d}), -1L) <= x then {d - 1}" for d in range(1, w))
    kept = f"(case {back} else {w - 1} end) + (case {on} else {w - 1} end) + 1 >= least({w}, size(g))"
    chosen = f"filter(transform(g, (x, j) -> case when {kept} then shiftleft(x, 32) + j end), y -> y is not null)"
    return let("g", rolling(words, k), chosen)


def fingerprints(df: DataFrame, k: int = 5, w: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint``: an array of (hash, position) for each row.

    A null text is empty and has an empty fingerprint; under k words, the whole is one gram. Null ids and repeated
    rows stay as they are; other columns are left out.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spread = "transform(f, x -> named_struct('hash', shiftright(x, 32), 'position', cast(x & 4294967295L as int)))"
    return rows.select(id_col, F.expr(fingerprint_expr("text", k, w)).alias("f")).select(id_col, F.expr(spread).alias("fingerprint"))


def hash_set(packed: str) -> str:
    """The distinct hashes of a packed fingerprint."""
    return f"array_distinct(transform({packed}, x -> cast(shiftright(x, 32) as int)))"


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both))


def written(packed: str) -> str:
    """A packed fingerprint as text, hash:position with the hash in hex, by position: all that ``read`` needs."""
    return f"array_join(transform({packed}, x -> concat(lower(hex(shiftright(x, 32))), ':', cast(x & 4294967295L as string))), ' ')"


def read(fingerprint: str) -> list[tuple[int, int]]:
    """Hashes and positions of a fingerprint as ``written``."""
    return [(int(h, 16), int(p)) for h, p in (x.split(":") for x in fingerprint.split())]


def with_next(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Add ``next``, a struct of ``cols`` of the row with the next id, to ``df``; after the last comes the first.

    Ids (integers; null comes first) are cut into ranges at quantiles, which are ids that occur. A row whose id starts
    a range also goes, as a guard, to the end of the range before; the first row of all to the end of the last. So one
    shuffle by range is all, and no range depends on another. Rows with the same id follow each other by ``cols``.
    """
    n, known = df.agg(F.count("*"), F.count(id_col)).first()
    want = min(RANGES, n // RANGE)
    quantiles = F.percentile_approx(id_col, F.array(*(F.lit((i + 1) / (want + 1)) for i in range(want))), max(10_000, 8 * want))
    lowest, *cuts = df.agg(F.min(id_col), *([quantiles] if want else [])).first()
    cuts = sorted(x for x in set((cuts or [None])[0] or []) if x != lowest or n != known)
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>") if cuts else F.lit(None).cast("array<bigint>")
    steps = ", ".join(str(1 << b) for b in reversed(range(max(1, len(cuts).bit_length()))))
    lo = f"aggregate(array({steps}), 0, (a, s) -> if(coalesce(get(cuts_, a + s - 1) <= `{id_col}`, false), a + s, a))"
    first = F.col(id_col).isNull() if n != known else F.col(id_col).eqNullSafe(F.lit(lowest))
    ranged = df.withColumn("cuts_", bounds).withColumn("range_", F.expr(lo))
    at_cut = F.expr(f"coalesce(get(cuts_, range_ - 1) = `{id_col}`, false)")
    places = F.array_compact(
        F.array(
            F.struct(F.col("range_").alias("r"), F.lit(False).alias("guard")),
            F.when(at_cut, F.struct((F.col("range_") - 1).alias("r"), F.lit(True).alias("guard"))),
            F.when(first, F.struct(F.lit(len(cuts)).alias("r"), F.lit(True).alias("guard"))),
        )
    )
    placed = ranged.withColumn("places_", places).drop("cuts_", "range_").select("*", F.explode("places_").alias("place_")).drop("places_")
    # At the end of the last range the first row of all is the only guard, so guards of a range never mix.
    order = Window.partitionBy("place_.r").orderBy(F.col("place_.guard"), F.col(id_col).asc_nulls_first(), *cols)
    return placed.withColumn("next", F.lead(F.struct(*cols)).over(order)).where(~F.col("place_.guard")).drop("place_")


def compare_edited(df: DataFrame, k: int = 5, w: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) characters replaced by as many of the start of the next row's
    text (or all). Gives ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``;
    fingerprints are as ``written``, hashes with positions.
    A null text is empty. A table of one row is its own next. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    printed = rows.withColumn("f", F.expr(fingerprint_expr("text", k, w)))
    half = "length(text) div 2"
    edited = with_next(printed, id_col, "text", "f").select(
        id_col, F.length("text").cast("long").alias("n_chars"), "f", F.expr(hash_set("f")).alias("hashes"), F.expr(hash_set("next.f")).alias("next_hashes"),
        F.expr(f"concat(left(text, length(text) - {half}), left(next.text, {half}))").alias("edited"),
    )
    edited = edited.withColumn("ef", F.expr(fingerprint_expr("edited", k, w)))
    return edited.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(written("f")).alias("fingerprint"), F.expr(written("ef")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.expr(hash_set("ef"))).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
