"""MinHash near-duplicates: a chosen-path set similarity join, exact confirmation, and components.

1. Each text becomes the set of its word shingles. Texts with the same set are one class; all that follows is about
   classes, so groups of exact copies cost one member each.
2. Each class has ``HASHES`` minwise tokens. ``ROOTS`` independent trees' first branches each split all classes by one
   token; below, a node splits its members by ``BRANCHES`` tokens that the node's own path chooses. A pair of
   likeness J follows a branch together with probability J, so at 0.8 it misses all roots with 0.2^8 < 3e-6, and all
   trees, however deep, with 0.25^8 < 2e-5 (it parts below a node with 0.0625, the root of q = (0.2 + 0.8 q)^2).
3. A node of up to ``SMALL`` members is compared exhaustively, by sketches. A larger one is first compared with a few
   pivots. Members much like a pivot are settled: they are paired with it (in a group of many near copies that is nearly
   all). Members unlike all pivots go down the tree; by the triangle inequality no settled one can be linked to them.
   Members in between, and from ``DEPTH`` on all that are left in a node of up to ``CROWD``, will meet their whole node.
   A larger one goes on down, so what meets a node grows with the members and not with their square.
4. Pairs are confirmed on their full sets, and links give components, in two rounds. The first takes the ``NEIGHBOURS``
   most alike candidates of each member. The second takes the other candidates that the first has not brought into one
   component (links inside one would change nothing), and lets members meet their node, a block with a block at a time:
   first by sketches, to find who has a candidate in another component, then these by full sets. Only links leave.
   Members whose pivot the first round did not confirm meet their node as well.
5. Members settled by pivots of components that are different after that meet each other: those near the other's pivot,
   a block with a block at a time, first by sketches and then by full sets.

Nothing here emits all pairs of a large group, and no node, hub or class is gathered in one task or on the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.llm.common import release, staged
from loomnote.llm.components import connected
from loomnote.sources.staging import ready_to_cut

HASHES, ROOTS, BRANCHES, DEPTH = 128, 8, 2, 3
#: Members of a node that is compared exhaustively, pivots of a larger one, members of a block.
SMALL, PIVOTS, BLOCK = 64, 8, 128
#: Members of a node that those left at ``DEPTH`` or below meet; from ``DEEPEST`` on they meet a node of any size.
CROWD, DEEPEST = 4096, 24
#: Classes whose texts are looked for by broadcasting their ids (40 bytes each); more are joined by shuffle.
BROADCAST_CLASSES = 200_000
#: Words whose hash a worker remembers.
REMEMBERED = 100_000

# Of HASHES equal tokens: a pair is a candidate from ``_candidate`` on (4.6 standard deviations below the threshold), a
# member is settled by a pivot from ``_settled`` on, and near it from ``_near`` on (a linked settled member away, less 3).


def _cuts(least: int) -> tuple[int, int, int]:
    j = least / 100
    sd = (HASHES * j * (1 - j)) ** 0.5
    near = max(0.0, 2 * j - 1)
    return max(1, int(HASHES * j - 4.6 * sd)), min(HASHES, int(HASHES * j + 1.25 * sd)), max(1, int(HASHES * near - 3 * (HASHES * near * (1 - near)) ** 0.5))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        n = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = n
        return n


@functools.cache
def _word_hash():
    return _Words().__getitem__


def _mixed(x):
    """Finalise 64-bit hashes."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, k: int):
    """Sorted distinct 64-bit hashes of all runs of ``k`` words; fewer words are one run, none are none.

    Words are runs without ASCII white space, A-Z in lower case: just what bytes.split and bytes.lower do.
    """
    import numpy as np

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, "u8")
    h = np.fromiter(map(_word_hash(), words), "u8", n)
    out = np.zeros(max(1, n - k + 1), "u8")
    with np.errstate(over="ignore"):
        for j in range(min(k, n)):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
        return np.unique(out + np.uint64(min(k, n)))


@functools.cache
def _multipliers():
    import numpy as np

    rng = np.random.default_rng(20240229)
    return rng.integers(1 << 63, size=(HASHES, 1), dtype="u8") * np.uint64(2) + np.uint64(1), rng.integers(1 << 63, size=(HASHES, 1), dtype="u8")


def signature(hashes):
    """``HASHES`` minwise tokens of a set, as 64-bit integers."""
    import numpy as np

    a, b = _multipliers()
    least = np.full(HASHES, np.iinfo("u8").max, "u8")
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):  # bounded memory for any length
            least = np.minimum(least, (hashes[at : at + 4096] * a + b).min(axis=1))
    return least


def _roots(tokens):
    """The nodes of a set below the roots: a hash of the tree and its whole token."""
    import numpy as np

    with np.errstate(over="ignore"):
        return _mixed(tokens[:ROOTS] + np.arange(1, ROOTS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)).view("i8")


def _sketch(tokens) -> bytes:
    """16 bits of each token: enough to compare, and to branch on below the roots."""
    return _mixed(tokens).astype("u2").tobytes()


def _hashed(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, text_key, n, key, roots, tokens``: set size, class key, first nodes and sketch (null for empty sets) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            n, keys, roots, tokens = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, k)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                least = signature(s) if len(s) else None
                roots.append(None if least is None else _roots(least))
                tokens.append(None if least is None else _sketch(least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(tokens, pa.binary())], names=["id", "text_key", "n", "key", "roots", "tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, text_key long, n long, key binary, roots array<long>, tokens binary")


def _sketches(column):
    """Each row's sketch, as a matrix."""
    import numpy as np

    held = b"".join(column.to_pylist())
    return np.frombuffer(held, "u2").reshape(len(column), HASHES)


def _alike_sizes(n, m, least: int):
    """Whether sets of n and m members can be linked."""
    import numpy as np

    return 100 * np.minimum(n, m) >= least * np.maximum(n, m)


PAIRS = "a long, b long, equal int"


def _pairs(a, b, equal) -> pa.RecordBatch:
    import numpy as np

    a, b = np.asarray(a, "i8"), np.asarray(b, "i8")
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(np.asarray(equal, "i4"))], names=["a", "b", "equal"])


def _compare_small(rows: DataFrame, least: int) -> DataFrame:
    """Candidate pairs within nodes of at most ``SMALL`` members; ``rows`` (node, key, n, tokens)."""
    candidate = _cuts(least)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for batch in batches:
            held = pa.concat_batches([held, batch]) if held is not None else batch
            node = held.column(0).to_numpy()
            last = int(np.searchsorted(node, node[-1])) if len(node) else 0
            if last:
                yield from compare(held.slice(0, last), node[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from compare(held, held.column(0).to_numpy())

    def compare(batch: pa.RecordBatch, node) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys, n, sketch = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _sketches(batch.column(3))
        step = 1
        while step < len(node):
            same = np.flatnonzero(node[step:] == node[:-step])
            if not len(same):
                break
            same = same[_alike_sizes(n[same], n[same + step], least)]
            equal = (sketch[same] == sketch[same + step]).sum(axis=1)
            same, equal = same[equal >= candidate], equal[equal >= candidate]
            if len(same):
                yield _pairs(keys[same], keys[same + step], equal)
            step += 1

    return rows.select("node", "key", "n", "tokens").repartition("node").sortWithinPartitions("node").mapInArrow(run, PAIRS)


def _compare_lists(rows: DataFrame, least: int) -> DataFrame:
    """For ``rows`` (node, key, n, tokens, pivots, tree, stays): the pivots each is like.

    Gives ``node, key, n, tokens, tree, stays, settled, near, mates``: whether some pivot settles the row, whether one is near, and
    the pivots it is to be paired with: the first that settles it, or else all candidates.
    """
    candidate, enough, close = _cuts(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            keys, n, sketch = b.column(1).to_pylist(), b.column(2).to_numpy(), _sketches(b.column(3))
            lists = b.column(4)
            count = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(n)), count)
            m, their, names = flat.field("n").to_numpy(), _sketches(flat.field("tokens")), flat.field("key").to_pylist()
            equal = (sketch[owner] == their).sum(axis=1)
            itself = np.array([keys[i] == x for i, x in zip(owner, names)], bool) if len(names) else np.empty(0, bool)
            fit = _alike_sizes(n[owner], m, least) & ~itself
            settled, near, mates = np.zeros(len(n), bool), np.zeros(len(n), bool), [[] for _ in n]
            np.logical_or.at(near, owner[(equal >= close)], True)
            for j in np.flatnonzero(fit & (equal >= enough)):
                i = owner[j]
                if not settled[i]:
                    settled[i] = True
                    mates[i] = [{"mate": names[j], "equal": int(equal[j])}]
            for j in np.flatnonzero(fit & (equal >= candidate)):
                if not settled[owner[j]]:
                    mates[owner[j]].append({"mate": names[j], "equal": int(equal[j])})
            yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column("tree"), b.column("stays"), pa.array(settled), pa.array(near), pa.array(mates, pa.list_(pa.struct([("mate", pa.int64()), ("equal", pa.int32())])))], names=["node", "key", "n", "tokens", "tree", "stays", "settled", "near", "mates"])

    return rows.select("node", "key", "n", "tokens", "pivots", "tree", "stays").mapInArrow(run, "node long, key long, n long, tokens binary, tree int, stays boolean, settled boolean, near boolean, mates array<struct<mate long, equal int>>")


#: Candidates of each member that the first round confirms.
NEIGHBOURS = 4


def _bridge_cuts(least: int) -> tuple[int, int]:
    """Of HASHES equal tokens: what two pivots have whose settled members can be linked, and what such a member has with the other pivot (4.6 standard deviations below)."""
    shares = (max(0.0, 1 - steps * (1 - least / 100)) for steps in (3, 2))
    return tuple(int(HASHES * j - 4.6 * (HASHES * j * (1 - j)) ** 0.5) for j in shares)


def _blocks(rows: DataFrame, left: str, right: str, sizes: DataFrame, *cols: str) -> DataFrame:
    """``node, x, y, at_x, at_y``: each block of about ``BLOCK`` of the ``rows`` that ``left`` is true of with each of those of ``right`` in the same node, and which blocks they are.

    ``sizes`` (node, of_x, of_y) has the number of either: a few rows that meet a large node are one block, not many of one row.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("key"), F.ceil(F.col(f"of_{name}") / BLOCK))
        return df.join(sizes, "node").groupBy("node", block.alias("block")).agg(F.collect_list(F.struct(*cols)).alias(name)).withColumnRenamed("block", f"at_{name}")

    return cut(rows.where(left), "x").join(cut(rows.where(right), "y"), "node").select("node", "x", "y", "at_x", "at_y")


def _sides(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``node, of_x, of_y``: of how many rows of each node ``left`` and ``right`` are true."""
    return rows.groupBy("node").agg(F.count_if(F.expr(left)).alias("of_x"), F.count_if(F.expr(right)).alias("of_y"))


def _met(x, y, least: int):
    """Of two blocks: keys and components, and which rows (y, x) are candidates in different components."""
    import numpy as np

    (kx, nx, cx, sx), (ky, ny, cy, sy) = ((v.field("key").to_numpy(), v.field("n").to_numpy(), v.field("component").to_numpy(), _sketches(v.field("tokens"))) for v in (x, y))
    # A step of the loop for each row of the shorter block.
    equal = np.stack([(sx == s).sum(axis=1) for s in sy] if len(sy) <= len(sx) else [(sy == s).sum(axis=1) for s in sx], axis=int(len(sy) > len(sx)))
    return kx, ky, cx, cy, (equal >= _cuts(least)[0]) & _alike_sizes(nx[None, :], ny[:, None], least) & (cx[None, :] != cy[:, None])


def _with_candidates(blocks: DataFrame, least: int, name: str) -> DataFrame:
    """``node, key`` of the rows that have a candidate in another component. A pair of blocks gives one row, with the keys of either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, xs, ys = [], [], []
            for row in range(b.num_rows):
                kx, ky, _, _, hit = _met(b.column(1)[row].values, b.column(2)[row].values, least)
                if hit.any():
                    rows.append(row)
                    xs.append(kx[hit.any(axis=0)].tolist())
                    ys.append(ky[hit.any(axis=1)].tolist())
            at = pa.array(rows, pa.int64())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in (0, 3, 4)), pa.array(xs, lists), pa.array(ys, lists)], names=["node", "at_x", "at_y", "x", "y"])

    met = _in_small_batches(blocks.mapInArrow(run, "node long, at_x long, at_y long, x array<long>, y array<long>"), BLOCK_ROWS, name)
    # A block's keys come once for each block that it met; they are few, and made distinct before they become rows.
    of = lambda side: met.groupBy("node", f"at_{side}").agg(F.array_distinct(F.flatten(F.collect_list(side))).alias("keys")).select("node", F.explode("keys").alias("key"))
    return of("x").union(of("y")).distinct()


def _shared(x, y, least: int) -> bool:
    """Whether two sorted sets pass the threshold."""
    import numpy as np

    place = np.searchsorted(y, x)
    both = int((y[np.minimum(place, len(y) - 1)] == x).sum())
    return 100 * both >= least * (len(x) + len(y) - both)


def _links_of_blocks(blocks: DataFrame, least: int, once: bool = True) -> DataFrame:
    """Links (a, b) between different components; of two components that a pair of blocks has joined, no more are looked for there.

    ``once``: pairs that share an earlier root are left to that one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for row in range(b.num_rows):
                x, y = b.column(1)[row].values, b.column(2)[row].values
                kx, ky, cx, cy, hit = _met(x, y, least)
                (tx, rx, mx), (ty, ry, my) = ((v.field("tree").to_numpy(), np.stack(v.field("roots").to_numpy(zero_copy_only=False)), v.field("set")) for v in (x, y))
                tree = int(tx[0])
                if once and tree > 0:  # a pair that shares an earlier root has met there
                    hit &= ~(ry[:, None, :tree] == rx[None, :, :tree]).any(axis=2)
                sets: dict[tuple[int, int], object] = {}

                def members(side: int, i: int):
                    if (side, i) not in sets:
                        sets[side, i] = np.frombuffer((my if side else mx)[i].as_buffer(), "u8")
                    return sets[side, i]

                joined: dict[int, int] = {}

                def find(c: int) -> int:
                    while c in joined:
                        c = joined[c]
                    return c

                found = []
                for j, i in zip(*np.nonzero(hit)):
                    one, two = find(int(cx[i])), find(int(cy[j]))
                    if one != two and _shared(members(0, i), members(1, j), least):
                        joined[one] = two
                        found.append((int(kx[i]), int(ky[j])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, parts)


def candidates(classes: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a > b, equal) of ``classes`` (key, n, roots, tokens) by the chosen-path trees.

    Also the members of large nodes, with what their pivots said (None if there are none).
    """
    rows = classes.select("key", "n", "tokens", F.posexplode("roots").alias("tree", "node"))
    small, members = [], []
    for depth in range(1, DEEPEST + 1):
        large = staged(rows.groupBy("node").agg(F.count("*").alias("members")).where(F.col("members") > SMALL), f"large{depth}")
        small.append(rows.join(large, "node", "left_anti").select("node", "key", "n", "tokens"))
        most = large.agg(F.max("members")).first()[0]
        if most is None:
            break
        stays = F.lit(depth >= DEPTH) & ((F.col("members") <= CROWD) | F.lit(depth == DEEPEST))
        inside = rows.join(large, "node").select("node", "key", "n", "tokens", "tree", "members", stays.alias("stays"))
        # Pivots are the members with the least hashes (the same in every tree, so pairs repeat): a bounded list, kept
        # small before the shuffle by taking hashes below a bound that 4 * PIVOTS members pass on average.
        order = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 40))
        low = inside.withColumn("order", order).where(F.col("order") < 4.0 * PIVOTS * (1 << 40) / F.col("members"))
        pivots = low.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", "key", "n", "tokens"))), 1, PIVOTS).alias("pivots"))
        none = F.array().cast(pivots.schema["pivots"].dataType)
        seen = _compare_lists(inside.join(pivots, "node", "left").withColumn("pivots", F.coalesce("pivots", none)), least)
        # What no pivot settles and what was near one, or is left at the end, will meet the node's members.
        meets = ~F.col("settled") & (F.col("near") | F.col("stays"))
        members.append(staged(seen.withColumn("meets", meets).drop("stays"), f"members{depth}"))
        if depth == DEEPEST or depth >= DEPTH and most <= CROWD:  # nobody goes on
            break
        chosen = F.array(*(F.pmod(F.xxhash64(F.col("node"), F.lit(j)), F.lit(HASHES)).cast("int") for j in range(BRANCHES)))
        branch = F.transform(chosen, lambda i: F.xxhash64(F.col("node"), i, F.substring("tokens", 2 * i + 1, F.lit(2))))
        rows = staged(members[-1].where("not settled and not meets").select("key", "n", "tokens", F.lit(-1).alias("tree"), F.explode(branch).alias("node")), f"branch{depth}")
        release(rows.sparkSession)
    found = _compare_small(_all(small), least)
    if not members:
        return found, None
    every = _all(members)
    mates = every.select("key", F.explode("mates").alias("x")).select("key", "x.*")
    return found.unionAll(mates.select(F.greatest("key", "mate").alias("a"), F.least("key", "mate").alias("b"), "equal")), every


def _confirm(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs whose full sets pass the threshold; ``sets`` (key, members: the sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            passed = []
            for x, y in zip(b.column(2), b.column(3)):
                passed.append(_shared(np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8"), least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(passed, pa.bool_()))

    one = pairs.select("a", "b").join(sets.select(F.col("key").alias("a"), F.col("members").alias("x")), "a")
    both = one.join(sets.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: Rows of an Arrow batch with a text in each row, two full sets (a few kilobytes each, most often), two blocks, or two blocks with sets.
TEXTS, SETS, BLOCK_ROWS, SET_BLOCK_ROWS = 1000, 1000, 100, 8


def _in_small_batches(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Stage ``df``, whose rows are large, with that many in an Arrow batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    try:
        conf.set(key, str(rows))
        return staged(df, name)
    finally:
        conf.set(key, before)


def _links(pairs: DataFrame, sets: DataFrame, least: int, name: str) -> DataFrame:
    return _in_small_batches(_confirm(pairs, sets, least), SETS, name)


def _labels(classes: DataFrame, joined: DataFrame) -> DataFrame:
    """``key, component`` of every class; one without links is its own."""
    return classes.select("key").join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("component"))


def _full_sets(df: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``key, members`` of the classes that are in ``pairs``, from the text of one row each."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = staged(classes.join(ends, "key").select("key", "first.id", "first.text_key"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).alias("id_"), F.xxhash64(text).alias("text_key_"), text.alias("text"))
    involved = texts.join(wanted, F.col("id_").eqNullSafe(F.col("id")) & (F.col("text_key_") == F.col("text_key"))).select("key", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, k).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["key", "members"])

    # A row that is repeated exactly gives its class's set more than once; one is enough.
    return staged(involved.mapInArrow(full, "key long, members binary").dropDuplicates(["key"]), "sets")


def _links_in_nodes(df: DataFrame, classes: DataFrame, members: DataFrame, part_of: DataFrame, k: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """Links between components that meet in a large node: of the members that are to meet it, and of those whose pivot was not confirmed."""
    slim = members.select("node", "key", "tree", "meets", F.when(F.col("settled"), F.col("mates")[0]["mate"]).alias("mate")).join(part_of, "key")
    apart = slim.join(part_of.select(F.col("key").alias("mate"), F.col("component").alias("of_mate")), "mate", "left").withColumn("meets", F.col("meets") | F.coalesce(F.col("of_mate") != F.col("component"), F.lit(False)))
    # In the roots' nodes a member meets all its nodes or none, so that a pair can be looked at in the first that it shares.
    anywhere = apart.where("meets and tree >= 0").select("key", F.lit(True).alias("met")).distinct()
    apart = staged(apart.join(anywhere, "key", "left").select("node", "key", "tree", "component", (F.col("meets") | (F.coalesce("met", F.lit(False)) & (F.col("tree") >= 0))).alias("meets")), "apart")
    # Only nodes where somebody meets others, of several components, matter; only there sketches are needed.
    split = apart.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("meets").alias("any")).where("any and lo <> hi").select("node")
    mixed = staged(apart.join(split, "node", "left_semi").join(classes.select("key", "n", "tokens"), "key"), "mixed")
    flagged = staged(_with_candidates(_blocks(mixed, "meets", "true", _sides(mixed, "meets", "true"), "key", "n", "tokens", "component"), least, "flagged"), "candidates")
    sets = _full_sets(df, classes, flagged.select(F.col("key").alias("a"), F.col("key").alias("b")), k, id_col, text_col)
    some = mixed.join(flagged, ["node", "key"])
    whole = some.join(classes.select("key", "roots"), "key").join(sets.withColumnRenamed("members", "set"), "key")
    blocks = _blocks(whole, "meets", "true", _sides(some, "meets", "true"), "key", "n", "tokens", "component", "tree", "roots", "set")
    return _in_small_batches(_links_of_blocks(blocks, least), SET_BLOCK_ROWS, "links3")


def _near_other(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` whose tokens and other_tokens (the last two columns) have at least ``least`` equal; other_tokens is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            equal = (_sketches(b.column("tokens")) == _sketches(b.column("other_tokens"))).sum(axis=1)
            yield b.filter(pa.array(equal >= least, pa.bool_())).drop_columns(["other_tokens"])

    out = rows.drop("other_tokens")
    return rows.mapInArrow(run, out.schema)


def _bridges(df: DataFrame, classes: DataFrame, members: DataFrame, part_of: DataFrame, k: int, least: int, id_col: str, text_col: str) -> DataFrame | None:
    """Links between members of a large node that pivots of different components have settled (None if there are no such pivots).

    A settled member outside its pivot's component has met its node before.
    """
    of_pivots, of_members = _bridge_cuts(least)
    settled = members.where("settled").select("node", "key", "tree", F.col("mates")[0]["mate"].alias("mate")).join(part_of, "key")
    settled = settled.join(part_of.select(F.col("key").alias("mate"), F.col("component").alias("of_mate")), "mate").where("component = of_mate").drop("of_mate")
    split = settled.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("node")
    settled = staged(settled.join(split, "node", "left_semi"), "settled")
    if settled.isEmpty():
        return None
    sketches = classes.select("key", "tokens")
    pivots = settled.select("node", "mate", "component").distinct().join(sketches.withColumnRenamed("key", "mate"), "mate")
    others = pivots.select("node", F.col("mate").alias("other"), F.col("component").alias("of_other"), F.col("tokens").alias("other_tokens"))
    ways = pivots.join(others, "node").where("component <> of_other").select("node", "mate", "other", "tokens", "other_tokens")
    ways = staged(_near_other(ways, of_pivots).drop("tokens").join(others.select("node", "other", "other_tokens"), ["node", "other"]), "ways")
    # A row for each of at most PIVOTS others.
    near = settled.join(ways, ["node", "mate"]).join(classes.select("key", "n", "tokens"), "key").select("node", "key", "tree", "component", "n", "mate", "other", "tokens", "other_tokens")
    near = _near_other(near, of_members)
    # A pair of pivots in a node is known by a number of its own; the side of the lesser pivot meets the other.
    near = near.withColumn("left", F.col("mate") < F.col("other")).withColumn("node", F.xxhash64("node", F.least("mate", "other"), F.greatest("mate", "other"))).drop("mate", "other")
    near = staged(near, "near")
    flagged = staged(_with_candidates(_blocks(near, "left", "not left", _sides(near, "left", "not left"), "key", "n", "tokens", "component"), least, "flagged"), "candidates")
    sets = _full_sets(df, classes, flagged.select(F.col("key").alias("a"), F.col("key").alias("b")), k, id_col, text_col)
    some = near.join(flagged, ["node", "key"])
    whole = some.join(classes.select("key", "roots"), "key").join(sets.withColumnRenamed("members", "set"), "key")
    blocks = _blocks(whole, "left", "not left", _sides(some, "left", "not left"), "key", "n", "tokens", "component", "tree", "roots", "set")
    return _in_small_batches(_links_of_blocks(blocks, least, once=False), SET_BLOCK_ROWS, "links4")


def near_duplicates(df: DataFrame, k: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_key, n_shingles, component_id, kept, component`` for each row.

    Two rows are linked if 100 * intersection >= ``least`` * union of their sets of k-word shingles; ``component_id`` is
    the least id that a row reaches by links, itself included. A text without words, or null, has an empty set and is
    linked with nothing. A null id has no say in ``component_id`` and is kept only if nothing with an id is in its
    component, whose number is ``component`` (null for an empty set). Rows of one id with different texts are rows of their own. Repeated rows are alike. Columns other than
    these two are left out. ``text_key`` is a hash of the text.
    """
    spark = df.sparkSession
    ready_to_cut(spark)
    # Each step's plans, and the shuffles they hold, go before the next: this is many plans, and the driver has them all.
    release(spark)
    hashed = _in_small_batches(_hashed(df, k, id_col, text_col), TEXTS, "hashed")
    filled = hashed.where("key is not null")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    classes = filled.groupBy("key").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("tokens").alias("tokens"))
    # From here on a class is known by a number; its row is written, so the number stays.
    classes = staged(classes.withColumnRenamed("key", "digest").withColumn("key", F.monotonically_increasing_id()), "classes")
    release(spark)
    found, members = candidates(classes.select("key", "n", "roots", "tokens"), least)
    pairs = staged(found.groupBy("a", "b").agg(F.first("equal").alias("equal")), "pairs")
    release(spark)
    sets = _full_sets(df, classes, pairs, k, id_col, text_col)
    release(spark)

    # Round 1: each member's most alike candidates (ranks are cut before the shuffle).
    ways = pairs.select("a", "b", "equal", F.explode(F.array("a", "b")).alias("me"))
    order = Window.partitionBy("me").orderBy(F.col("equal").desc(), "a", "b")
    first_pairs = staged(ways.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS).select("a", "b").distinct(), "first")
    links = _links(first_pairs, sets, least, "links1")
    # Round 2: what is still in different components.
    part_of = staged(_labels(classes, connected(links)), "parts")
    release(spark)
    of = lambda name: part_of.select(F.col("key").alias(name), F.col("component").alias(f"of_{name}"))
    more = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select("a", "b")
    second_pairs = staged(more.distinct().join(first_pairs, ["a", "b"], "left_anti"), "second")
    links = links.unionAll(_links(second_pairs, sets, least, "links2"))
    release(spark)
    if members is not None:
        links = links.unionAll(_links_in_nodes(df, classes, members, part_of, k, least, id_col, text_col))
        release(spark)
    joined = connected(links)
    release(spark)
    if members is not None:
        bridges = _bridges(df, classes, members, _labels(classes, joined), k, least, id_col, text_col)
        if bridges is not None and not bridges.isEmpty():
            joined = connected(links.unionAll(bridges))
    # Back to rows: class, component of classes, then the least id of the component.
    of_class = _labels(classes, joined).join(classes.select("key", F.col("first.id").alias("least_id")), "key")
    least_ids = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = of_class.join(least_ids, "component").join(classes.select("key", "digest"), "key").select("digest", "component_id", "component")
    out = hashed.select("id", "text_key", "n", F.col("key").alias("row_key")).join(of_class, F.col("row_key") == F.col("digest"), "left")
    least_id = F.when(F.col("row_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), least_id.alias("component_id"), F.col("id").eqNullSafe(least_id).alias("kept"), "component")
