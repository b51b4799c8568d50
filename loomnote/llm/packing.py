"""Packing by best-fit decreasing: every document's token ids into windows of a fixed size with little padding.

A document of T ids (the tokenizer's, then an end id) is first cut into full windows; its last piece of under
``size`` ids is packed best-fit decreasing: longest first, each into the open window with the least room that
still holds it, found by a segment tree indexed by remaining capacity.

Pieces of one length are interchangeable, so the packer needs only how many there are of each length: at most
``size`` counts, whatever the corpus. It places a whole run of equal pieces at once, in the windows where one
after the other would have gone, and returns a plan of intervals: pieces ranked r0 to r1 of a length go to windows
from s on, k in each, from an offset on. The plan's size depends on ``size`` alone (each length touches a group of
windows once and splits two at most). A piece's rank is its number among the pieces of its length in the task that
cut it, counted there and written with it, plus how many the tasks before it have. So nothing is sorted to rank
pieces, repeated or null ids are no hot key, and neither is a length that a third of all pieces share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.llm.bpe import fast_encoding
from loomnote.llm.common import staged

class RoomTree:
    """A segment tree over remaining capacities 0 to ``size``: how many groups of windows have each."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.size = size
        self.held = [0] * (2 * self.base)

    def add(self, room: int, n: int) -> None:
        i = self.base + room
        while i:
            self.held[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` that some window has, or -1."""
        i = self.base + need
        while not self.held[i]:
            while i & 1:  # a right child: nothing further right below its parent
                i >>= 1
                if i <= 1:
                    return -1
            i += 1
            if i & (i - 1) == 0:
                return -1
        while i < self.base:
            i *= 2
            if not self.held[i]:
                i += 1
        return i - self.base


def best_fit_plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Intervals (length, rank_from, rank_to, per_window, first_window, offset) for ``counts`` pieces of each length below ``size``; the windows used.

    The same windows as one-by-one best fit: after a piece goes into the tightest window, that window, if it still
    has room, is the tightest for the next piece of this length.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    tree, groups, windows = RoomTree(size), [[] for _ in range(size + 1)], 0

    def put(first: int, n: int, room: int) -> None:
        if n and room:
            groups[room].append((first, n))
            tree.add(room, 1)

    for length in sorted((k for k, n in counts.items() if n and k > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = size
                each = size // length
                first, n = windows, -(-left // each)
                windows += n
            else:
                first, n = groups[room].pop()
                tree.add(room, -1)
                each = room // length
            whole = min(n, left // each)
            some = left - whole * each if whole < n else 0
            put(first, whole, room - each * length)
            if some:
                put(first + whole, 1, room - some * length)
            untouched = n - whole - bool(some)
            put(first + n - untouched, untouched, room)
            placed = whole * each + some
            plan.append((length, rank, rank + placed, each, first, size - room))
            rank, left = rank + placed, left - placed
    return plan, windows


def pieces(df: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, task, rank``: each document's ids cut into full windows and a rest.

    ``rank`` numbers the pieces of a length in one task. Both depend on how the rows lie, so the table is to be written before it is used twice.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoding, task, ranks = fast_encoding(path), TaskContext.get().partitionId(), [0] * (size + 1)
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
        for batch in batches:
            rows, start, length, crc, total, rank = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encoding.encode_to_numpy(text.as_py(), allowed_special="all"), end_id).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append(row)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    rank.append(ranks[len(part)])
                    ranks[len(part)] += 1
            numbers = (start, length, crc, total, [task] * len(rows), rank)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in numbers)], names=names)

    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long")


def pack(df: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null text is empty and has the end id alone. Repeated rows and repeated ids are packed each for themselves;
    equal pieces are interchangeable. A null id stays null. An empty table gives no rows. Other columns are left out.
    """
    spark = df.sparkSession
    cut = staged(pieces(df, path, size, end_id, id_col, text_col), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # one row per length: at most ``size``
    plan, windows = best_fit_plan({k: n for k, n in counts.items() if k < size}, size)
    if counts.get(size):
        plan.append((size, 0, counts[size], 1, windows, 0))

    # How many pieces of a length the tasks before have: a row per length and task, not per piece.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = cut.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))

    intervals = spark.createDataFrame(plan, "length long, rank_from long, rank_to long, each long, first_window long, at long")
    i = F.col("rank") - F.col("rank_from")
    # The plan has a fixed bound (see above), so it may be broadcast.
    return placed.join(F.broadcast(intervals), (placed["length"] == intervals["length"]) & (placed["rank"] >= intervals["rank_from"]) & (placed["rank"] < intervals["rank_to"])).select(
        id_col, "start", placed["length"], "ids_crc32", "doc_tokens",
        (F.col("first_window") + F.floor(i / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(i, F.col("each")) * placed["length"]).cast("long").alias("offset"),
    )
