"""All pairs of similar notes, or the best of each note, by blocks of notes.

A block holds some notes of a notebook as one compressed row: their paths, their terms in order, and for each term the
notes that have it. What is sent between tasks is small beside the terms: a block's distinct terms once, as hashes,
to count and number them, and the counts and numbers back, by broadcasts of bounded size. Blocks are written once; they meet in rounds, in each of which a tile of
blocks is broadcast and all blocks are read against it, so no block is sent by shuffle to the others. Terms that few notes
have are multiplied, by merging sorted term lists; what the others can add to a pair at most is the product of the two notes' lengths in
them, and pairs that may reach the threshold so are worked out in full. A block is one row of bounded size, so no term is
a hot key, and only pairs over the threshold leave a task, with their top term.

Where the best of each note are asked for, a task keeps no more than those of each note, and after 1, 2, 4, ... rounds the best so far
replace what the rounds wrote; the least of a full list is what a later pair has to reach. So rows on disk grow with the
notes and not with the pairs, whose number is the square of a group of copies.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.sources.staging import delete, release, staged, staging_path

KEYS = ["notebook_id", "relative_path"]
#: Entries that a block may hold.
ENTRIES = 400_000
#: Entries of a tile, which is broadcast, and rounds that run at a time.
TILE, ROUNDS = 1_600_000, 2
#: Entries whose terms are counted in one group.
COUNTED = 4_000_000
#: Entries whose terms are sent to be counted at a time. Frequencies of blocks of a quarter of them are broadcast at a time: the driver holds those several times over.
SENT = 60_000_000
#: Most terms of a block that are bounded before they are multiplied, and the shares of notes that part them: a bound for each part is lower than one for all.
COLUMNS = 4096
SHARES = (0.03, 0.05, 0.08, 0.12, 0.2, 0.35)
#: Digits that scores are rounded to before the threshold, so that the order of sums cannot matter.
DIGITS = 9
PAIRS = "notebook_id string, a string, b string, sim double, top_term string"
COUNTS = "block long, bucket int, dfs binary"
FINISHED = "notebook_id string, block long, tile int, payload binary"
BEST = "notebook_id string, block long, note int, me string, other string, sim double, top_term string"


def blocked_pairs(note_term: DataFrame, notes: DataFrame, threshold: float, most: int, dense: float, best: int | None = None) -> DataFrame:
    """``notebook_id, a, b, sim, top_term`` of the pairs a < b with about the threshold or more.

    ``note_term`` may be ``terms.term_lists`` as well, whose terms are counted where blocks are packed.
    With ``best``, ``notebook_id, block, note, me, other, sim, top_term``: for each note its ``best`` most similar ones (ties: the lesser path).
    A block has up to ``most`` notes; terms with at least a share ``dense`` of a notebook's notes are bounded before they are multiplied.
    """
    spark = note_term.sparkSession
    schema = PAIRS if best is None else BEST
    known = note_term.where("notebook_id is not null and relative_path is not null")
    if "terms" in known.columns:
        packed = known.select(*KEYS, "terms")
    else:
        packed = known.groupBy(*KEYS).agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("xs"))
    # A note's terms are a long row; a task's blocks are one part, so they need not be sorted.
    asked = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.maxConcurrentOutputFileWriters": "1"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        made = packed.mapInArrow(_pack(most), "notebook_id string, block long, entries long, payload binary")
        made, raw_path = made.withColumn("part", F.shiftright("block", 32).cast("int")), staging_path(spark)
        made.write.partitionBy("part").option("compression", "zstd").parquet(raw_path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    release(spark)  # the shuffles that led to the blocks
    raw = spark.read.schema(made.schema).parquet(raw_path)
    sizes = sorted(raw.select("notebook_id", "block", "entries").collect(), key=lambda r: (r.notebook_id, r.block))  # one for each block
    if not sizes:
        delete(spark, raw_path)
        return spark.createDataFrame([], schema)

    entries = sum(r.entries for r in sizes)
    n_buckets, dfs_path = 1 + entries // COUNTED, staging_path(spark)
    step = -(-n_buckets // (1 + entries // SENT))
    for first in range(0, n_buckets, step):  # some buckets at a time: hashes take as much room as blocks
        sent = raw.mapInArrow(_distinct(n_buckets, range(first, min(first + step, n_buckets))), "notebook_id string, block long, bucket int, hashes binary, counts binary")
        sent.groupBy("notebook_id", "bucket").applyInArrow(_count, COUNTS).write.mode("append").option("compression", "zstd").parquet(dfs_path)
        release(spark)
    dfs = spark.read.schema(COUNTS).parquet(dfs_path)
    tiles, members = _tiles(sizes)
    n = notes.groupBy("notebook_id").agg(F.count("*").alias("n"))
    n = F.broadcast(n) if len(members) < 100_000 and n.count() < 100_000 else n
    known = raw.join(F.broadcast(spark.createDataFrame(tiles, "block long, tile int")), "block").join(n, "notebook_id")
    path, finishing, end = staging_path(spark), {r.block >> 32 for r in sizes}, max(r.block for r in sizes)
    for first, last in _spans(sizes):  # blocks stay where they are: their frequencies are broadcast, some at a time
        here = F.col("block").between(first, last)
        parts = dfs.where(here).groupBy("block").agg(F.collect_list(F.struct("bucket", "dfs")).alias("parts"))
        placed = known.where(here & F.col("part").between(first >> 32, last >> 32)).join(F.broadcast(parts), "block")
        finished = placed.select("notebook_id", "block", "tile", "n", "payload", "parts").mapInArrow(_finish(n_buckets), FINISHED)
        finished.write.mode("append").partitionBy("tile").option("compression", "zstd").parquet(path)
        for part in sorted(finishing):  # what is finished goes at once
            if last >> 32 > part or last == end:
                delete(spark, f"{raw_path}/part={part}")
                finishing.remove(part)
        del parts, placed, finished
        release(spark)  # the driver's copies of what was broadcast
    done, drop_done = spark.read.schema(FINISHED).parquet(path), lambda: delete(spark, path)
    delete(spark, raw_path)
    delete(spark, dfs_path)
    release(spark)

    out = staging_path(spark)
    floors: dict[int, object] = {}

    def meet(tile: int) -> None:
        mine = done.where(F.col("tile") == tile).select("notebook_id", "block", "payload").collect()
        held = spark.sparkContext.broadcast(([tuple(r) for r in mine], floors))
        rest = done.where(F.col("tile") >= tile)
        if len(members[tile]) < 100:
            rest = rest.where(F.col("notebook_id").isin(sorted(members[tile])))
        rest.select("notebook_id", "block", "payload").mapInArrow(_meet(held, threshold, dense, best), schema).write.parquet(f"{out}/{tile}")
        held.destroy()

    found, drop_found, at, step = None, None, 0, len(members) if best is None else 1
    while at < len(members):
        group = range(at, min(at + step, len(members)))
        with ThreadPoolExecutor(ROUNDS) as pool:
            list(pool.map(meet, group))
        made = spark.read.schema(schema).parquet(*(f"{out}/{tile}" for tile in group))
        if best is None:
            found = made
        else:
            found, drop_old = _best_of(made if found is None else found.unionAll(made), best), drop_found
            found, drop_found = staged(found)
            if drop_old:
                drop_old()
            for tile in group:
                delete(spark, f"{out}/{tile}")
            release(spark)
            floors = _floors(found, best) if group.stop < len(members) else {}
        at, step = group.stop, group.stop
    drop_done()
    return found


def _spans(sizes: list) -> list[tuple[int, int]]:
    """The first and last blocks of runs of about a quarter of ``SENT`` entries."""
    most = max(SENT // 4, 1)
    spans, filled = [], most
    for r in sorted(sizes, key=lambda r: r.block):
        if filled >= most:
            spans.append((r.block, r.block))
            filled = 0
        spans[-1] = (spans[-1][0], r.block)
        filled += r.entries
    return spans


def _best_of(rows: DataFrame, best: int) -> DataFrame:
    """The ``best`` rows of each note, as ``BEST``."""
    order = Window.partitionBy("block", "note").orderBy(F.round("sim", DIGITS).desc(), "other")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).drop("rank")


def _floors(found: DataFrame, best: int) -> dict[int, tuple]:
    """For each block the notes whose lists are full, and the least similarity there: 6 bytes for a note."""
    import numpy as np

    full = found.groupBy("block", "note").agg(F.count("*").alias("n"), F.min("sim").cast("float").alias("least")).where(F.col("n") >= best)
    rows = full.groupBy("block").agg(F.collect_list("note").alias("notes"), F.collect_list("least").alias("least")).toArrow()
    lists = ((x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in rows.column(c).chunks) for c in ("notes", "least"))
    notes, least = (np.concatenate([np.empty(0, t), *x]) for x, t in zip(lists, ("i4", "f4")))
    lengths = [len(x) for x in rows.column("notes")]
    ends = np.cumsum(lengths, dtype="i8")
    return {k: (notes[e - m : e].astype("u2"), least[e - m : e]) for k, m, e in zip(rows.column("block").to_pylist(), lengths, ends.tolist())}


def _tiles(sizes: list) -> tuple[list[tuple[int, int]], list[set[str]]]:
    """A tile for each block, and the notebooks of each tile."""
    tiles, members, filled = [], [set()], 0
    for r in sizes:
        if filled and filled + r.entries > TILE:
            members.append(set())
            filled = 0
        filled += r.entries
        members[-1].add(r.notebook_id)
        tiles.append((r.block, len(members) - 1))
    return tiles, members


def _dump(x: object) -> bytes:
    raw = pickle.dumps(x, 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(raw, asbytes=True)


def _load(data: bytes) -> object:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _pack(most: int):
    """Notes (notebook_id, relative_path, and xs or terms) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        made = 0
        held: dict[str, tuple[list[str], list[int], list[pa.Array], list[pa.Array]]] = {}

        def block(notebook: str) -> pa.RecordBatch:
            nonlocal made
            paths, lengths, terms, tfs = held.pop(notebook)
            coded = pa.concat_arrays(terms).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()  # by bytes, as strings compare
            rank = np.empty(len(order), "i4")
            rank[order] = np.arange(len(order), dtype="i4")
            code = rank[coded.indices.to_numpy()]
            by_term = np.argsort(code, kind="stable")
            words = coded.dictionary.take(pa.array(order))
            note = np.repeat(np.arange(len(paths), dtype="u2"), lengths)
            tf = pa.concat_arrays(tfs).to_numpy()
            payload = {"paths": paths, "words": _flat(words), "counts": np.bincount(code, minlength=len(order)).astype("u2"), "notes": note[by_term], "tfs": tf[by_term]}
            made += 1
            return _batch([(notebook, first + made, len(code), _dump(payload))], ["notebook_id", "block", "entries", "payload"], [pa.string(), pa.int64(), pa.int64(), pa.binary()])

        for batch in batches:
            if "terms" in batch.schema.names:
                offsets, terms, tfs = _counted(batch.column("terms"))
            else:
                xs = batch.column("xs")
                offsets, flat = xs.offsets.to_numpy(), xs.values
                terms, tfs = flat.field("term"), flat.field("tf")
            for i, (notebook, path) in enumerate(zip(batch.column("notebook_id").to_pylist(), batch.column("relative_path").to_pylist())):
                start, length = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                if not length:  # no terms: similar to none
                    continue
                if notebook in held and sum(held[notebook][1]) + length > ENTRIES:
                    yield block(notebook)
                own = held.setdefault(notebook, ([], [], [], []))
                for x, y in zip(own, (path, length, terms.slice(start, length), tfs.slice(start, length))):
                    x.append(y)
                if len(own[0]) == most:
                    yield block(notebook)
            for notebook, (paths, lengths, ts, fs) in list(held.items()):  # copies, so that no batch is held
                held[notebook] = (paths, lengths, [pa.concat_arrays([*ts, ts[0].slice(0, 0)])], [pa.concat_arrays([*fs, fs[0].slice(0, 0)])])
            while sum(sum(x[1]) for x in held.values()) > 5 * ENTRIES:  # many notebooks: the fullest goes
                yield block(max(held, key=lambda k: sum(held[k][1])))
        for notebook in list(held):
            yield block(notebook)
        pa.default_memory_pool().release_unused()

    return run


def _counted(lists: pa.Array) -> tuple:
    """Where each list's distinct strings start, these strings, and how often each occurs in its list."""
    import numpy as np

    offsets = lists.offsets.to_numpy().astype("i8")
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    words = max(len(coded.dictionary), 1)
    own = np.repeat(np.arange(len(lists), dtype="i8"), np.diff(offsets))
    kept, tfs = np.unique(own * words + coded.indices.to_numpy(), return_counts=True)
    return np.searchsorted(kept, np.arange(len(lists) + 1, dtype="i8") * words), coded.dictionary.take(pa.array(kept % words)), pa.array(tfs.astype("i4"))


def _flat(words: pa.Array) -> tuple[bytes, object]:
    """The strings' bytes and their lengths."""
    import pyarrow.compute as pc

    return b"".join(words.cast(pa.binary()).to_pylist()), pc.binary_length(words).to_numpy()


def _hash(words: tuple) -> object:
    """64 bits for each string, made byte by byte for all at a time."""
    import numpy as np

    data, length = np.frombuffer(words[0], "u1"), np.asarray(words[1], "i8")
    start = np.cumsum(length) - length
    h = np.full(len(length), 0xCBF29CE484222325, "u8") ^ (length.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
    left, at = np.argsort(-length, kind="stable"), 0
    ends = -length[left]
    while True:
        left = left[: np.searchsorted(ends, -at)]  # those longer than ``at``
        if not len(left):
            break
        x = h[left] ^ data[start[left] + at]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h[left] = x ^ (x >> np.uint64(32))
        at += 1
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _dealt(words: tuple, buckets: int) -> tuple[object, object, object]:
    """Hashes of a block's terms, their order by bucket and hash, and where each bucket starts there."""
    import numpy as np

    h = _hash(words)
    bucket = (h >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((h, bucket))
    return h, order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype="u8"))


def _distinct(buckets: int, some: range):
    """Blocks to the hashes of their terms and how many notes have each, by buckets of hashes, for ``some`` of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for notebook, block, payload in zip(*(batch.column(c).to_pylist() for c in ("notebook_id", "block", "payload"))):
                x = _load(payload)
                h, order, starts = _dealt(x["words"], buckets)
                parts = [(k, order[starts[k] : starts[k + 1]]) for k in some]
                rows = [(notebook, block, k, h[o].tobytes(), _dump(x["counts"][o])) for k, o in parts if len(o)]
                yield _batch(rows, ["notebook_id", "block", "bucket", "hashes", "counts"], [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _count(table: pa.Table) -> pa.Table:
    """Document frequencies and numbers of a bucket's terms, for each block in the order in which it sent them."""
    import numpy as np

    hashes = [np.frombuffer(x, "u8") for x in table.column("hashes").to_pylist()]
    counts = np.concatenate([_load(x) for x in table.column("counts").to_pylist()])
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    df = np.bincount(place, weights=counts).astype("i4")[place]
    place = place.astype("i4")
    ends = np.cumsum([len(x) for x in hashes])[:-1]
    parts = [_dump((x, np.diff(y, prepend=np.int32(0)))) for x, y in zip(np.split(df, ends), np.split(place, ends))]  # numbers rise as hashes do
    return pa.table([table.column("block"), table.column("bucket"), pa.array(parts, pa.binary())], names=["block", "bucket", "dfs"])


def _finish(buckets: int):
    """Blocks by the numbers of their terms, with norms and document frequencies, without the terms that one note has, or all: no pair shares those, or they weigh nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()
                x, n = _load(get("payload")), get("n")
                _, order, starts = _dealt(x["words"], buckets)
                df, ids = np.empty(len(order), "i4"), np.empty(len(order), "i8")  # as in ``order``
                for part in get("parts"):
                    here = slice(starts[part["bucket"]], starts[part["bucket"] + 1])
                    df[here], steps = _load(part["dfs"])
                    ids[here] = np.cumsum(steps, dtype="i8") + (part["bucket"] << 32)
                counts = x["counts"][order].astype("i8")
                begins = (np.cumsum(x["counts"], dtype="i8") - x["counts"])[order]
                entries = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                note, tf = x["notes"][entries], x["tfs"][entries]
                w = tf * np.repeat(_idf(df, n), counts)
                norms = np.sqrt(np.bincount(note, weights=w * w, minlength=len(x["paths"])))
                kept = (df > 1) & (df < n)
                of_kept = np.repeat(kept, counts)
                data, length = x["words"]
                known = np.zeros(len(order), bool)
                known[order] = kept
                words = (np.frombuffer(data, "u1")[np.repeat(known, length)].tobytes(), length[known])
                done = {"paths": x["paths"], "words": _dump(words), "buckets": buckets, "steps": np.diff(ids[kept], prepend=0), "counts": counts[kept].astype("u2"), "notes": note[of_kept], "tfs": tf[of_kept], "df": df[kept], "n": n, "norms": norms}
                yield _batch([(get("notebook_id"), get("block"), get("tile"), _dump(done))], ["notebook_id", "block", "tile", "payload"], [pa.string(), pa.int64(), pa.int32(), pa.binary()])

    return run


def _idf(df, n: int):
    import numpy as np

    return np.where(df < n, np.log(n / df), 0.0)


class _Block:
    """A block unpacked: ``ids`` are the sorted numbers of its terms, ``start`` and ``count`` their entries in ``note`` and ``u``.

    ``often`` are the terms that are bounded; ``lengths`` of the notes (notes x parts) in those.
    """

    def __init__(self, payload: bytes, dense: float):
        import numpy as np

        x = _load(payload)
        self.paths, self.packed, self.buckets = x["paths"], x["words"], x["buckets"]
        self.ids, self.count, self.note = np.cumsum(x["steps"]), x["counts"].astype("i8"), x["notes"]
        self.start = np.cumsum(self.count) - self.count
        with np.errstate(invalid="ignore", divide="ignore"):
            self.u = x["tfs"] * np.repeat(_idf(x["df"], x["n"]), self.count) / x["norms"][self.note]
        often = np.flatnonzero(x["df"] >= dense * x["n"])
        often = often[np.argsort(-x["df"][often], kind="stable")[:COLUMNS]]
        self.often = np.zeros(len(self.ids), bool)
        self.often[often] = True
        entries = np.repeat(self.often, self.count)
        part = np.repeat(np.searchsorted(SHARES, x["df"] / x["n"]), self.count)[entries]
        squares = np.bincount(self.note[entries] * np.int64(len(SHARES) + 1) + part, weights=self.u[entries] ** 2, minlength=len(self.paths) * (len(SHARES) + 1))
        self.lengths = np.sqrt(squares).reshape(len(self.paths), -1).astype("f4")
        self._by_note = self._same = self._rank = self._words = None

    def by_note(self) -> tuple:
        """Terms and weights of all notes, note by note, and where each note starts."""
        import numpy as np

        if self._by_note is None:
            by = np.argsort(self.note, kind="stable")
            term = np.repeat(np.arange(len(self.ids), dtype="i4"), self.count)[by]
            self._by_note = (term, self.u[by], np.searchsorted(self.note[by], np.arange(len(self.paths) + 1)))
        return self._by_note

    def of_note(self, i: int) -> tuple:
        """The terms of a note, in the order of their numbers, and their weights."""
        term, u, starts = self.by_note()
        return term[starts[i] : starts[i + 1]], u[starts[i] : starts[i + 1]]

    def same(self) -> object:
        """For each note the first one with the same terms and weights."""
        import numpy as np

        if self._same is None:
            first: dict[bytes, int] = {}
            self._same = np.array([first.setdefault(b"".join(x.tobytes() for x in self.of_note(i)), i) for i in range(len(self.paths))], "i8")
        return self._same

    def rank(self) -> object:
        """The place of each note's path in their order."""
        import numpy as np

        if self._rank is None:
            self._rank = np.empty(len(self.paths), "i8")
            self._rank[sorted(range(len(self.paths)), key=self.paths.__getitem__)] = np.arange(len(self.paths))
        return self._rank

    def word(self, term: int) -> str:
        import numpy as np

        if self._words is None:
            words = _load(self.packed)
            self._words = (words[0], np.concatenate([[0], np.cumsum(words[1], dtype="i8")]), _dealt(words, self.buckets)[1])
        data, begins, order = self._words
        return data[begins[order[term]] : begins[order[term] + 1]].decode()


def _meet(held, threshold: float, dense: float, best: int | None):
    least = threshold - 10.0**-DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tile = None

        def unpacked(notebook: str, block: int, payload: bytes) -> _Best:
            b = _Block(payload, dense)
            low = np.full(len(b.paths), least)
            if block in held.value[1]:
                notes, floor = held.value[1][block]
                low[notes] = np.maximum(least, floor * (1 - 1e-6) - 1e-8)  # rounded to single precision
            return _Best(notebook, block, b, low, best)

        for batch in batches:
            for notebook, block, payload in zip(*(batch.column(c).to_pylist() for c in ("notebook_id", "block", "payload"))):
                tile = tile or [unpacked(*x) for x in held.value[0]]
                own = [x for x in tile if x.block == block]
                b = own[0] if own else unpacked(notebook, block, payload)
                for a in tile:
                    if a.notebook == notebook and (not own or a.block <= block):
                        if best is None:
                            yield from _similar(a, b, least)
                        else:
                            _better(a, b, least)
                if best is not None and not own:
                    yield from b.rows()
        for a in tile or [] if best is not None else []:
            yield from a.rows()

    return run


def _rounded(sims) -> object:
    """``sims`` times 10 ** DIGITS, rounded as SQL rounds: halves of the decimal number go up."""
    import numpy as np

    x = sims * 10.0**DIGITS
    r = np.floor(x + 0.5)
    for k in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-5):
        r[k] = float(Decimal(repr(float(sims[k]))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return r.astype("i8")


def _first(me, best: int) -> object:
    """Which of the rows, sorted by ``me``, are among the first ``best`` of their kind."""
    import numpy as np

    at = np.arange(len(me))
    new = np.concatenate([[True], me[1:] != me[:-1]]) if len(me) else np.empty(0, bool)
    return at - np.maximum.accumulate(np.where(new, at, 0)) < best


class _Best:
    """A block, the best found of its notes, and ``low``: what is similar to a note by less is not among its best."""

    def __init__(self, notebook: str, block: int, data: _Block, low, best: int | None):
        self.notebook, self.block, self.data, self.low, self.best = notebook, block, data, low, best
        self.found: list[pa.Table] = []

    def choose(self, me, key, rank) -> object:
        """Which pairs may be among the best of the notes ``me``, given their rounded similarities and the order of the others' paths."""
        import numpy as np

        order = np.lexsort((rank, -key, me))
        return self._cut(me, key, order)

    def _cut(self, me, key, order) -> object:
        """The best of each note in ``order``; full lists raise ``low``."""
        kept = order[_first(me[order], self.best)]
        tail = kept[self.best - 1 :]
        last = tail[me[tail] == me[kept[: len(tail)]]]  # the last of each full list
        self.low[me[last]] = self.low[me[last]].clip((key[last] - 1) / 10.0**DIGITS)
        return kept

    def add(self, me, key, other: list[str], sims, top: list[str]) -> None:
        self.found.append(pa.table([pa.array(me, pa.int32()), pa.array(key), pa.array(other, pa.string()), pa.array(sims), pa.array(top, pa.string())], names=["me", "key", "other", "sim", "top"]))
        if sum(t.num_rows for t in self.found) > 4 * self.best * len(self.data.paths) + 1000:
            self.found = [self._pruned()]

    def _pruned(self) -> pa.Table:
        import pyarrow.compute as pc

        t = pa.concat_tables(self.found)
        order = pc.sort_indices(t, sort_keys=[("me", "ascending"), ("key", "descending"), ("other", "ascending")]).to_numpy()
        return t.take(pa.array(self._cut(t.column("me").to_numpy(), t.column("key").to_numpy(), order))).combine_chunks()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            t = self._pruned()
            paths = pa.array(self.data.paths, pa.string())
            columns = [pa.array([self.notebook] * t.num_rows, pa.string()), pa.array([self.block] * t.num_rows, pa.int64()), t.column("me"), paths.take(t.column("me").combine_chunks()), t.column("other"), t.column("sim"), t.column("top")]
            yield from pa.table(columns, names=["notebook_id", "block", "note", "me", "other", "sim", "top_term"]).to_batches(10_000)
        self.found = []


def _similar(a: _Best, b: _Best, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks, or of one."""
    for i, j, sims in _candidates(a, b, least):
        for at in range(0, len(i), 10_000):
            part = slice(at, at + 10_000)
            tops = _tops(a.data, b.data, i[part], j[part])
            ends = [(a.data.paths[x], b.data.paths[y]) for x, y in zip(i[part].tolist(), j[part].tolist())]
            rows = [(a.notebook, min(e), max(e), s, top) for e, s, top in zip(ends, sims[part].tolist(), tops)]
            yield _batch(rows, ["notebook_id", "a", "b", "sim", "top_term"], [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()])


def _better(a: _Best, b: _Best, least: float) -> None:
    """The pairs of two blocks, or of one, that may be among the best of an end, added to that end."""
    import numpy as np

    for i, j, sims in _candidates(a, b, least):
        key = _rounded(sims)
        if a is b:  # each pair is seen from both ends
            i, j, key, sims = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([key, key]), np.concatenate([sims, sims])
        sides = [(a, i, b, j)] if a is b else [(a, i, b, j), (b, j, a, i)]
        for x, me, y, other in sides:
            may = np.flatnonzero(key >= x.low[me] * 10.0**DIGITS - 2)
            kept = may[x.choose(me[may], key[may], y.data.rank()[other[may]])]
            if len(kept):
                x.add(me[kept], key[kept], [y.data.paths[k] for k in other[kept].tolist()], sims[kept], _tops(a.data, b.data, i[kept], j[kept]))


def _tops(a: _Block, b: _Block, i, j) -> list[str]:
    """The term with the largest share of each pair, the least of several; copies are looked at once."""
    import numpy as np

    known: dict[tuple[int, int], str] = {}
    pairs = list(zip(a.same()[i].tolist(), b.same()[j].tolist()))
    for x, y in pairs:
        if (x, y) not in known:
            (ta, ua), (tb, ub) = a.of_note(x), b.of_note(y)
            _, xs, ys = np.intersect1d(a.ids[ta], b.ids[tb], assume_unique=True, return_indices=True)
            share = np.round(ua[xs] * ub[ys], 12)
            known[x, y] = min(a.word(int(t)) for t in ta[xs[share == share.max()]])
    return [known[p] for p in pairs]


def _candidates(a: _Best, b: _Best, least: float) -> Iterator[tuple]:
    """Notes of ``a`` and of ``b`` and their similarities, where that is ``least`` or more and reaches what either end asks for; some at a time."""
    import numpy as np

    bound, x, y = _products(a.data, b.data)
    # Single precision finds the pairs: a sum of so many products, none negative, is off by less than this share of it.
    off = 1 - 1e-3 - len(x) * 2.4e-7
    low_a, low_b = (np.maximum(z.low, 0).astype("f4") * np.float32(max(off, 0)) for z in (a, b))
    i, j = np.nonzero(bound >= np.minimum(low_a[:, None], low_b[None, :]))
    if a is b:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return
    alike, place = np.unique(a.data.same()[i] * len(b.data.paths) + b.data.same()[j], return_inverse=True)  # copies are worked out once
    sims = _exact(a.data, b.data, x, y, alike // len(b.data.paths), alike % len(b.data.paths))[place]
    ok = (sims >= least) & (sims > 0)
    if ok.any():
        yield i[ok], j[ok], sims[ok]


def _exact(a: _Block, b: _Block, x, y, i, j) -> object:
    """Cosines of the notes ``i`` of ``a`` and ``j`` of ``b``, sorted by i, in double precision; ``x`` and ``y`` are the terms they share."""
    import numpy as np

    (sa, ua, ba), (sb, ub, bb) = _shared(a, x), _shared(b, y)
    weight, out = np.zeros(len(x)), np.zeros(len(i))
    cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else []
    for first, last in zip(cuts[:-1], cuts[1:]):
        for at in range(first, last, 256):
            others = j[at : min(last, at + 256)]
            note = i[first]
            own = sa[ba[note] : ba[note + 1]]
            weight[own] = ua[ba[note] : ba[note + 1]]
            if len(others) == 1:
                k = slice(bb[others[0]], bb[others[0] + 1])
                out[at] = weight[sb[k]] @ ub[k]
            else:
                length = bb[others + 1] - bb[others]
                ends = np.cumsum(length)
                k = np.arange(ends[-1]) + np.repeat(bb[others] - ends + length, length)
                sums = np.concatenate([[0.0], np.cumsum(weight[sb[k]] * ub[k])])
                out[at : at + len(others)] = sums[ends] - sums[ends - length]
            weight[own] = 0
    return out


def _shared(block: _Block, terms) -> tuple:
    """Entries of ``terms``, by their place there, note by note; their weights; where each note starts."""
    import numpy as np

    term, u, starts = block.by_note()
    place = np.full(len(block.ids), -1, "i8")
    place[terms] = np.arange(len(terms))
    at = place[term]
    kept = at >= 0
    return at[kept], u[kept], np.concatenate([[0], np.cumsum(kept)])[starts]


def _products(a: _Block, b: _Block) -> tuple:
    """What the cosines of all notes of ``a`` and ``b`` are at most, in single precision, and the terms that both blocks have."""
    import numpy as np

    _, x, y = np.intersect1d(a.ids, b.ids, assume_unique=True, return_indices=True)
    rare = ~(a.often[x] & b.often[y])
    sims = (a.lengths @ b.lengths.T).ravel()
    ia, ca, ib, cb = (z[rare] for z in (a.start[x], a.count[x], b.start[y], b.count[y]))
    rows = np.cumsum(ca * cb)
    cuts = np.searchsorted(rows, np.arange(500_000, rows[-1] if len(rows) else 0, 500_000))
    for part in np.split(np.arange(len(ia)), cuts):  # products of a bounded number at a time
        if len(part):
            n = ca[part] * cb[part]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(cb[part], n)
            across = k // width
            p, q = np.repeat(ia[part], n) + across, np.repeat(ib[part], n) + k - across * width
            sims += np.bincount(a.note[p].astype("i8") * len(b.paths) + b.note[q], weights=a.u[p] * b.u[q], minlength=sims.size).astype("f4")
    return sims.reshape(len(a.paths), len(b.paths)), x, y
