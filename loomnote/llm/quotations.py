"""Quotation linking: quoted passages of chat messages, joined to the messages that they come from.

A message's lines are parsed into levels: the number of quote marks (">") that a line starts with. Runs of lines of
one level are passages. What a message says itself is its level 0; what it quotes at level 1 is what its parent said,
at level 2 what the parent quoted, and so on. Lines are normalised (marks, case, runs of white space, an "On ... wrote:"
line before a quote) and hashed, and passages as well where they are linked whole. A quote has one origin: the latest
message before it that says its passage or else its line (``whole``), or the first of the conversation that says the line;
a quote joins to that one row, so a line that very many messages say, or a conversation with very many messages, costs
a row for each quote and no more.

A message replies to the origin of its level-1 lines: the one that most of them come from, the latest if several do.
If none of these is found, the origin of its level-2 lines takes their place, and so on. Without a quote that is found, it follows the message before it (``linked_by`` says which). The conversation without
quotes is ``clean`` by ``position``: a walk through the tree of replies, each message followed by its replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomnote.llm.common import staged
from loomnote.sources.staging import ready_to_cut

#: A line that introduces a quote.
INTRODUCTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
#: The marks at the start of a quoted line.
MARKS = r"^((?:[ \t]*>)*)"


def levels(text: Column) -> Column:
    """``array<struct<level, words, line>>`` of a text's lines: quote level, the line without marks, and that normalised."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r", -1)
    marks = lambda line: F.regexp_extract(line, MARKS, 1)

    def parse(line: Column) -> Column:
        said = F.regexp_replace(F.regexp_replace(line, MARKS, ""), "^[ \t]", "")
        level = F.length(F.regexp_replace(marks(line), "[^>]", ""))
        return F.struct(level.alias("level"), said.alias("words"), normalised(said).alias("line"))

    return F.transform(lines, parse)


def normalised(line: Column) -> Column:
    """A line as it is compared: lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\s ]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """Add to each message: ``lines`` (as ``levels``, without introductions), ``clean`` (its own lines), ``quoted`` lines, ``max_level``."""
    parsed = messages.withColumn("lines", levels(F.col("text")))
    # An introduction is dropped where a deeper line follows it.
    kept = F.filter("lines", lambda x, i: ~(F.regexp_like(x["words"], F.lit(INTRODUCTION)) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > x["level"])))
    parsed = parsed.withColumn("lines", kept)
    own = F.filter("lines", lambda x: x["level"] == 0)
    clean = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["words"]), "\n"), r"^\n+|\n+$", ""), r"\n{3,}", "\n\n")
    return parsed.withColumn("clean", clean).withColumn("max_level", F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)))


def runs_of_a_level(lines: Column) -> Column:
    """``array<struct<level, words, lines>>`` of the passages, runs of one level, of ``lines`` (as of ``levels``, without empty ones)."""
    start = F.transform(lines, lambda x, i: F.when((i == 0) | ~F.get(lines, i - 1)["level"].eqNullSafe(x["level"]), i))
    starts = F.filter(start, lambda i: i.isNotNull())

    def run(at: Column, j: Column) -> Column:
        part = F.slice(lines, at + 1, F.coalesce(F.get(starts, j + 1), F.size(lines)) - at)
        return F.struct(part[0]["level"].alias("level"), F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("words"), F.transform(part, lambda x: x["line"]).alias("lines"))

    return F.transform(starts, run)


def _latest(quotes: DataFrame, said: DataFrame, name: str) -> DataFrame:
    """``conv_id, turn, h, check, name``: for each of ``quotes`` the latest turn before it in which ``said`` has the same; both have ``conv_id, turn, h, check``."""
    keys = ["conv_id", "h", "check"]
    quotes = quotes.select(*keys, "turn").distinct()
    said = said.select(*keys, "turn").join(quotes.select(*keys).distinct(), keys, "left_semi")
    both = quotes.withColumn("quoted", F.lit(True)).unionAll(said.withColumn("quoted", F.lit(False))).groupBy(*keys, "turn")
    # A row a turn; turns are ranged as in _before, so that a frequent line of a long conversation is many groups.
    rows = both.agg(F.max("quoted").alias("quoted"), F.max(~F.col("quoted")).alias("says")).withColumn("range", F.floor(F.col("turn") / TURNS))
    rows = rows.withColumn("said", F.when(F.col("says"), F.col("turn")))
    so_far = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.max("said").over(so_far(*keys, "range").orderBy("turn"))).where("quoted")
    ranges = rows.groupBy(*keys, "range").agg(F.max("said").alias("last")).select(*keys, "range", F.max("last").over(so_far(*keys).orderBy("range")).alias("earlier"))
    return inside.join(ranges, [*keys, "range"]).select(*keys, "turn", F.coalesce("inside", "earlier").alias(name))


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per message: ``conv_id, turn, role, part, clean, n_quoted, n_found, n_deeper, n_deeper_found, max_level, origins, parent_turn, linked_by, link_level, position, depth``.

    ``clean`` is the text without quotes; ``n_quoted`` counts level-1 lines with words, ``n_found`` those whose origin, an
    earlier turn of the conversation, was found; ``n_deeper`` and ``n_deeper_found`` count those of level 2 and more.
    ``origins`` (``level, turn, n``) has the turn that most lines of each level come from. ``linked_by`` is "quote",
    "order" or "start", ``link_level`` the level of the quote that it is by, or null. ``position`` counts turns of
    the conversation from 0 in reply order, ``depth`` the replies above.

    ``whole``: lines come from the latest earlier turn that says the whole passage that they are quoted in, and those of
    a passage that no turn says as a whole from the latest that says the line. Otherwise each line stands alone and
    comes from the first turn that says it.

    A null text is empty. A message with a null conversation or turn is a conversation of its own (linked_by "start",
    position 0). Several messages of one turn, or repeated rows, share a turn's links and differ in ``part``.
    Other columns are left out. Column names are the parameters' on input and fixed on output.
    """
    spark = df.sparkSession
    ready_to_cut(spark)
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    parsed = passages(rows).withColumn("part", F.monotonically_increasing_id())
    parsed = staged(parsed.select("conv_id", "turn", "role", "part", "clean", "max_level", F.filter("lines", lambda x: x["line"] != "").alias("lines")), "messages")
    known = parsed.where("conv_id is not null and turn is not null")
    hashed = lambda col: (F.xxhash64(col).alias("h"), F.sha1(col).alias("check"))
    if whole:
        runs = known.select("conv_id", "turn", "part", F.explode(runs_of_a_level(F.col("lines"))).alias("x"))
        runs = staged(runs.select("conv_id", "turn", "part", "x.level", *hashed("x.words"), "x.lines"), "runs")
        lines = runs.select("conv_id", "turn", "part", "level", F.col("h").alias("run_h"), F.col("check").alias("run_check"), F.explode("lines").alias("line"))
        lines = lines.select("conv_id", "turn", "part", "level", "run_h", "run_check", *hashed("line"))
        of_run = _latest(runs.where("level >= 1"), runs.where("level = 0"), "of_run").withColumnsRenamed({"h": "run_h", "check": "run_check"})
        of_line = _latest(lines.where("level >= 1"), lines.where("level = 0"), "of_line")
        quotes = lines.where("level >= 1").join(of_run, ["conv_id", "turn", "run_h", "run_check"], "left").join(of_line, ["conv_id", "turn", "h", "check"], "left")
        quotes = quotes.withColumn("origin", F.coalesce("of_run", "of_line"))
    else:
        lines = known.select("conv_id", "turn", "part", F.explode("lines").alias("x")).select("conv_id", "turn", "part", "x.level", *hashed("x.line"))
        # One origin per line and conversation, so the join cannot grow beyond the quotes; the digest confirms the hash.
        origins = lines.where("level = 0").groupBy("conv_id", "h", "check").agg(F.min("turn").alias("origin"))
        quotes = lines.where("level >= 1").join(origins, ["conv_id", "h", "check"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    votes = quotes.groupBy("part", "level", "origin").agg(F.count("*").alias("n"))
    found = F.col("origin").isNotNull()
    by_level = votes.groupBy("part", "level").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias("found"), F.max(F.when(found, F.struct("n", "origin"))).alias("best"))
    count = lambda name, which: F.coalesce(F.sum(F.when(which, F.col(name))), F.lit(0))
    first, deeper = F.col("level") == 1, F.col("level") > 1
    origin = F.when(F.col("best").isNotNull(), F.struct("level", F.col("best.origin").alias("turn"), F.col("best.n").alias("n")))
    voted = by_level.groupBy("part").agg(
        count("n", first).alias("n_quoted"), count("found", first).alias("n_found"), count("n", deeper).alias("n_deeper"), count("found", deeper).alias("n_deeper_found"),
        F.array_sort(F.collect_list(origin)).alias("origins"),
    )
    # A turn's link: by quote if one of its messages has one (the least level, then the latest origin), else the turn before.
    least = F.get("origins", F.lit(0))
    linking = voted.select("part", F.when(least.isNotNull(), F.struct((-least["level"]).alias("above"), least["turn"].alias("turn"))).alias("quoted"))
    turns = known.join(linking, "part", "left").groupBy("conv_id", "turn").agg(F.max("quoted").alias("quoted"))
    turns = turns.select("conv_id", "turn", F.col("quoted.turn").alias("quoted_turn"), (-F.col("quoted.above")).alias("link_level"))
    turns = staged(_before(turns, ["conv_id"], "previous"), "turns")
    parent = F.coalesce("quoted_turn", "previous")
    linked = F.when(F.col("quoted_turn").isNotNull(), "quote").when(F.col("previous").isNotNull(), "order").otherwise("start")
    turns = turns.select("conv_id", "turn", parent.alias("parent_turn"), linked.alias("linked_by"), "link_level")
    placed = turns.join(_reply_order(turns.drop("linked_by", "link_level")), ["conv_id", "turn"])
    out = parsed.join(voted, "part", "left").join(placed, ["conv_id", "turn"], "left")
    none = F.array().cast(voted.schema["origins"].dataType)
    return out.select(
        "conv_id", "turn", "role", "part", "clean", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_quoted", "n_found", "n_deeper", "n_deeper_found")),
        F.col("max_level").cast("long").alias("max_level"), F.coalesce("origins", none).alias("origins"), "parent_turn", F.coalesce("linked_by", F.lit("start")).alias("linked_by"), "link_level",
        F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )


#: Turns of a group that share a range when looking for the one before.
TURNS = 1024


def _before(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``, the turn before among the rows with the same ``keys`` (null-safe). Turns are ranged first, so that a long group is many."""
    ranged = rows.withColumn("range", F.floor(F.col("turn") / TURNS))
    inside = F.lag("turn").over(Window.partitionBy(*keys, "range").orderBy("turn"))
    # One row per range: what a range starts from is the last turn of the range before.
    last = ranged.groupBy(*keys, "range").agg(F.max("turn").alias("last"))
    last = last.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("range").alias("r"), F.lag("last").over(Window.partitionBy(*keys).orderBy("range")).alias("before"))
    same = F.col("range") == F.col("r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}"))
    return ranged.withColumn("inside", inside).join(last, same).select(*rows.columns, F.coalesce("inside", "before").alias(name))


def _reply_order(turns: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``conv_id, turn, position, depth`` of ``turns`` (conv_id, turn, parent_turn): the place in a walk that follows replies.

    The walk enters and leaves each turn once; entering leads to the first reply or to leaving, leaving to the next
    reply of the same parent or to leaving the parent. Pointer jumping sums up, in log(length) rounds, how many turns
    are entered from here to the end (the position from behind), and how deep the walk is.
    """
    turns = _before(turns, ["conv_id", "parent_turn"], "elder")
    first = turns.where("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("first"))
    younger = turns.where("elder is not null").select("conv_id", F.col("turn").alias("younger"), F.col("elder").alias("turn"))
    tree = turns.join(first, ["conv_id", "turn"], "left").join(younger, ["conv_id", "turn"], "left")
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    steps = F.array(
        F.struct(enter("turn").alias("e"), F.coalesce(enter("first"), leave("turn")).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("deep")),
        F.struct(leave("turn").alias("e"), F.coalesce(enter("younger"), leave("parent_turn")).alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("deep")),
    )
    walk = tree.select("conv_id", F.explode(steps).alias("s")).select("conv_id", "s.*").checkpoint()
    for _ in range(most_rounds):
        open_ = walk.where("next is not null")  # what has reached its end is looked up, but looks no further
        if open_.isEmpty():
            break
        then = walk.select("conv_id", F.col("e").alias("next"), F.col("next").alias("after"), F.col("entered").alias("more"), F.col("deep").alias("further"))
        moved = open_.join(then, ["conv_id", "next"]).select("conv_id", "e", F.col("after").alias("next"), (F.col("entered") + F.col("more")).alias("entered"), (F.col("deep") + F.col("further")).alias("deep"))
        walk = walk.where("next is null").select(moved.columns).unionAll(moved).checkpoint()
    total = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    return walk.where("pmod(e, 2) = 0").join(total, "conv_id").select("conv_id", F.floor(F.col("e") / 2).alias("turn"), (F.col("n") - F.col("entered")).alias("position"), (-F.col("deep")).alias("depth"))
