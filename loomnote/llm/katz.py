"""Language-model scores: a Katz backoff bigram model with Good-Turing discounts, learnt and applied across a cluster.

    P(w | h) = d(c) * c(h, w) / c(h)   if the bigram was seen,
               a(h) * P(w)             else;         P(w) = d'(c) * c(w) / N, or the mass left for the unknown word.

d(c) are Katz's Good-Turing discounts for counts up to ``KATZ``; a(h) makes the probabilities after h sum to exactly 1
over the training vocabulary, the end and one unknown word. A word that training never saw is the unknown word; after
it, or after a history that training never saw, P(w | h) = P(w).

Tokens are moved as packed arrays, not as rows:

1. Blocks of documents are tokenized. A block holds its tokens as numbers of its own dictionary.
2. Dictionaries, cut by word hash into parts, are merged part by part: words get ids and training counts, which go
   back to the blocks. Counts of counts of words give d'.
3. Blocks send each bigram, with the documents it occurs in, to the part of its history, where bigrams are counted: a
   table partitioned by history, with the counts of counts and the sums of the few histories that have a large share
   of all tokens; those are spread over parts by the word that follows.
4. A pass over that table, where it lies, evaluates every token, bigram first and unigram where it backs off, and sums
   by document.

Only sums reach the driver: N, V, the number of training texts and counts of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnote.llm.common import discard, staged

#: Counts up to this are discounted.
KATZ = 5
#: Tokens and documents of a block (a longer document is a block of its own); least count of a history that is spread.
BLOCK_TOKENS, BLOCK_DOCS, SPREAD = 1_250_000, 60_000, 200_000
#: Tokens of a part: their number grows with the data, and what a task holds does not.
PART_TOKENS = 1_500_000
#: Ids of the unknown word and of the start of a text.
UNKNOWN, START = 0xFFFFFFFE, 0xFFFFFFFF
#: Words whose hash a worker remembers.
REMEMBERED = 100_000


def _pack(*arrays) -> bytes:
    """Unsigned arrays as one compressed value, byte planes apart."""
    import numpy as np
    import zstandard

    out = []
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for a in arrays:
        a = np.ascontiguousarray(a)
        most = int(a.max()) if len(a) else 0
        width = max(1, (most.bit_length() + 7) // 8)
        planes = a.view("u1").reshape(len(a), a.itemsize)[:, :width].T if len(a) else np.empty((width, 0), "u1")
        body = b"".join(_framed(squeeze(np.ascontiguousarray(p).tobytes())) for p in planes)
        out.append(len(a).to_bytes(4, "little") + bytes([a.itemsize, width]) + body)
    return b"".join(out)


def _framed(b: bytes) -> bytes:
    return len(b).to_bytes(4, "little") + b


def _unpack(data: bytes) -> list:
    import numpy as np
    import zstandard

    expand, out, at = zstandard.ZstdDecompressor().decompress, [], 0
    while at < len(data):
        n, size, width = int.from_bytes(data[at : at + 4], "little"), data[at + 4], data[at + 5]
        at += 6
        a = np.zeros((n, size), "u1")
        for k in range(width):
            m = int.from_bytes(data[at : at + 4], "little")
            a[:, k] = np.frombuffer(expand(data[at + 4 : at + 4 + m], max_output_size=max(1, n)), "u1")
            at += 4 + m
        out.append(a.reshape(-1).view(f"<u{size}"))
    return out


def _mix(x):
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x.astype("u8") + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def discounts(n: list[int], katz: int = KATZ) -> list[float]:
    """d(1) to d(``katz``) from counts of counts n[1] to n[katz + 1].

    Katz's formula, where it gives values between 0 and 1 for all; else (few data) (r - 1/2) / r.
    """
    if all(n[r] > 0 for r in range(1, katz + 2)):
        rest = (katz + 1) * n[katz + 1] / n[1]
        if rest < 1:
            d = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, katz + 1)]
            if all(0 < x < 1 for x in d):
                return d
    return [(r - 0.5) / r for r in range(1, katz + 1)]


@dataclass
class Unigrams:
    """What is known of single tokens as a whole: N, V, training texts, and counts of counts n[1] to n[KATZ + 1]."""

    tokens: int
    types: int
    texts: int
    n: list[int]
    d: list[float] = field(default_factory=list)
    unknown: float = 1.0

    def __post_init__(self):
        self.d = discounts(self.n)
        low = sum(r * self.n[r] * (1 - self.d[r - 1]) for r in range(1, KATZ + 1))
        # Without rare words nothing would be left for the unknown one: then all counts give up one in N + 1.
        self.scale = 1.0 if low > 0 or not self.tokens else self.tokens / (self.tokens + 1)
        self.unknown = 1.0 if not self.tokens else (low / self.tokens if low > 0 else 1 / (self.tokens + 1))

    def log(self, c):
        """log10 P(w) for training counts ``c``; 0 is the unknown word."""
        import numpy as np

        return np.log10(np.where(c > 0, _discounted(c, self.d) * self.scale / max(1, self.tokens), self.unknown))

    def base(self, c):
        import numpy as np

        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def _discounted(c, d: list[float]):
    import numpy as np

    c = np.asarray(c, float)
    table = np.array([1.0, *d])
    return c * np.where(c <= KATZ, table[np.minimum(c, KATZ).astype(int)], 1.0)


# -- 1: blocks ---------------------------------------------------------------


def _blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two rows for each block, apart so that each kind can go when it is consumed: its documents and tokens, and its dictionary."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash
        from pyspark import TaskContext

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                n = xxhash.xxh64_intdigest(word)
                if len(word) <= 64:
                    self[word] = n
                return n

        hash_of, first, made = Words().__getitem__, TaskContext.get().partitionId() << 24, 0
        end = np.array([xxhash.xxh64_intdigest(b"\n")], "u8")  # no word has a line end in it

        def close(texts: list) -> pa.RecordBatch:
            nonlocal made
            texts.sort(key=lambda x: x[1])  # training texts first
            stream = np.concatenate([x[2] for x in texts])
            length = np.array([len(x[2]) for x in texts], "u4")
            train_texts = sum(not x[1] for x in texts)
            words, local = np.unique(stream, return_inverse=True)
            train = np.bincount(local[: int(length[:train_texts].sum())], minlength=len(words)).astype("u4")
            made += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + made] * 2, pa.int64()), pa.array([[x[0].as_py() for x in texts], None], pa.list_(texts[0][0].type)), pa.array([train_texts, None], pa.int64()),
                    pa.array([len(stream), None], pa.int64()), pa.array([_pack(local.astype("u4"), length), _pack(words, train)], pa.binary()), pa.array(["tokens", "words"]),
                ],
                names=["block", "ids", "train_texts", "n_tokens", "packed", "holds"],
            )

        texts, n = [], 0
        for b in batches:
            for id_, held_out, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                words = text.as_py().encode("utf-8", "surrogatepass").lower().split()
                stream = np.concatenate([np.fromiter(map(hash_of, words), "u8", len(words)), end])
                if texts and (n + len(stream) > BLOCK_TOKENS or len(texts) >= BLOCK_DOCS):
                    yield close(texts)
                    texts, n = [], 0
                texts.append((id_, held_out, stream))
                n += len(stream)
        if texts:
            yield close(texts)

    held_out = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(10)) == 0
    rows = df.select(F.col(id_col), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, train_texts long, n_tokens long, packed binary, holds string")


# -- 2: dictionaries ---------------------------------------------------------


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """``block, part, words``: the dictionaries of ``blocks``, cut into parts by the hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for block, held in zip(b.column(0).to_pylist(), b.column(1)):
                words, train = _unpack(held.as_py())
                part = ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending, as the words are
                first, _ = _runs(part)
                cuts = [*first.tolist(), len(words)]
                out = [_pack(words[x:y], train[x:y]) for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array(part[first].astype("i4")), pa.array(out, pa.binary())], names=["block", "part", "words"])

    return blocks.select("block", "packed").mapInArrow(run, "block long, part int, words binary")


def _merge_dictionaries(entries: DataFrame, parts: int) -> DataFrame:
    """``entries`` (part, block, words) to rows (block, part, known: ids and counts of the block's words); block -1 has counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        part = table.column("part")[0].as_py()
        held = [_unpack(x) for x in table.column("words").to_pylist()]
        words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([c for _, c in held]), minlength=len(words)).astype("u8")
        rank = np.empty(len(words), "u8")
        rank[np.argsort(-count.astype("i8"), kind="stable")] = np.arange(len(words), dtype="u8")  # frequent words get small ids
        ids = rank * np.uint64(parts) + np.uint64(part)
        if len(ids) and int(ids.max()) >= UNKNOWN:
            raise OverflowError("the vocabulary exceeds 32-bit ids")
        ids = np.where(count > 0, ids, np.uint64(UNKNOWN)).astype("u4")
        count, cuts = count.astype("u8"), np.cumsum([0, *(len(w) for w, _ in held)])
        known = [_pack(ids[place[a:b]], count[place[a:b]]) for a, b in zip(cuts, cuts[1:])]
        low = [int((count == r).sum()) for r in range(1, KATZ + 2)]
        known.append(_pack(np.array([int(count.sum()), int((count > 0).sum()), *low], "u8")))
        blocks = pa.array([*table.column("block").to_pylist(), -1], pa.int64())
        return pa.table([blocks, pa.array([part] * len(known), pa.int32()), pa.array(known, pa.binary())], names=["block", "part", "known"])

    return entries.groupBy("part").applyInArrow(run, "block long, part int, known binary")


def _totals(packed: DataFrame) -> list[int]:
    """N, V and counts of counts: the sums of the packed ones of all parts."""
    names = [f"x{i}" for i in range(KATZ + 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [_unpack(x.as_py())[0].tolist() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x)], pa.int64()) for x in zip(*held)] if held else [pa.array([], pa.int64())] * len(names), names=names)

    sums = packed.select("known").mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return list(sums.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in names)).first())


# -- 3: bigrams by history ---------------------------------------------------


def _bigrams(blocks: DataFrame, parts: int, uni: Unigrams, spread: int, kind: str) -> DataFrame:
    """Blocks (block, ids, train_texts, packed, known) to rows of two kinds: a block's documents (part -block), and its bigrams of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for row in range(b.num_rows):
                block, train_texts = b.column(0)[row].as_py(), b.column(2)[row].as_py()
                local, length = _unpack(b.column(3)[row].as_py())
                known = [_unpack(x["known"]) for x in sorted(b.column(4)[row].as_py(), key=lambda x: x["part"])]
                id_of, count_of = (np.concatenate(x) for x in zip(*known))  # of the block's words
                del known
                ids, count = id_of[local], count_of[local]
                doc = np.repeat(np.arange(len(length), dtype="u2"), length)
                starts = np.cumsum(length) - length
                h, ch = np.empty_like(ids), np.empty_like(count)
                h[1:], ch[1:] = ids[:-1], count[:-1]
                h[starts], ch[starts] = START, uni.texts
                base = np.bincount(doc, weights=uni.base(count_of)[local], minlength=len(length))
                alone = ch == 0  # after an unknown history the unigram is all
                score = np.bincount(doc[alone], weights=uni.log(count_of)[local[alone]], minlength=len(length))
                n_known = np.bincount(doc[count > 0], minlength=len(length)).astype("i8")
                del local, id_of, count_of
                docs = pa.array([length.astype("i8").tolist()], pa.list_(pa.int64())), pa.array([n_known.tolist()], pa.list_(pa.int64())), pa.array([base.tolist()], pa.list_(pa.float64())), pa.array([score.tolist()], pa.list_(pa.float64()))
                ids_of = pa.array([b.column(1)[row].as_py()], b.schema.field(1).type)
                yield batch([block], [-block], [train_texts], [None], ids_of, *docs)

                seen = ~alone
                h, w, c, ch, doc = h[seen], ids[seen], count[seen], ch[seen], doc[seen]
                del ids, count, alone, seen
                part = _part_of(h, w, ch, spread, parts)
                key = h.astype("u8") << np.uint64(32) | w
                del h, w
                order = np.argsort(key, kind="stable")
                order = order[np.argsort(part[order], kind="stable")]
                key, doc, c, ch, part = key[order], doc[order], c[order], ch[order], part[order]
                del order
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if lo < hi:
                        yield batch([block], [p], [train_texts], [_pack_bigrams(key[lo:hi], doc[lo:hi], c[lo:hi], ch[lo:hi])], pa.array([None], b.schema.field(1).type), *(pa.array([None], x.type) for x in docs))

    names = ["block", "part", "train_texts", "bigrams", "ids", "n_tokens", "n_known", "base", "score"]

    def batch(block, part, train_texts, bigrams, *rest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int64()), pa.array(train_texts, pa.int64()), pa.array(bigrams, pa.binary()), *rest], names=names)

    return blocks.select("block", "ids", "train_texts", "packed", "known").mapInArrow(run, f"block long, part long, train_texts long, bigrams binary, ids array<{kind}>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>")


def _part_of(h, w, ch, spread: int, parts: int):
    """The part of each bigram: that of its history, or one of several by its word where the history is spread."""
    import numpy as np

    salt = np.zeros(len(h), "u8")
    large = np.flatnonzero(ch >= spread)
    salt[large] = _mix(w[large]) % (ch[large] // np.uint64(spread) + np.uint64(1))
    salt <<= np.uint64(32)
    salt += h
    return (_mix(salt) % np.uint64(parts)).astype("u4")


def _pack_bigrams(key, doc, c, ch) -> bytes:
    """Sorted bigrams with their documents: each history, each bigram and the count of each word is written once."""
    import numpy as np

    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[new, len(key)]).astype("u4")
    h, w = (key[new] >> np.uint64(32)).astype("u4"), (key[new] & np.uint64(0xFFFFFFFF)).astype("u4")
    first, runs = _runs(h)
    return _pack(np.diff(h[first], prepend=h.dtype.type(0)), runs, ch[new][first], _steps(w, runs), _of_words(w, c[new]), times, doc)


def _runs(sorted_) -> tuple:
    """Where runs of equal values start, and how long they are."""
    import numpy as np

    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, "i8")
    return first, np.diff(np.r_[first, len(sorted_)]).astype("u4")


def _steps(a, runs):
    """Runs of ascending values: the first of each, then differences (mod 2^bits)."""
    import numpy as np

    starts = np.cumsum(runs, dtype="i8") - runs
    step = np.diff(a, prepend=a.dtype.type(0))
    step[starts] = a[starts]
    return step


def _walked(step, runs):
    """The values of which ``step`` are the steps."""
    import numpy as np

    total = np.cumsum(step, dtype=step.dtype)
    before = np.concatenate([np.zeros(1, step.dtype), total[np.cumsum(runs, dtype="i8")[:-1] - 1]])
    total -= np.repeat(before, runs)
    return total


def _of_words(w, c):
    """The counts of the distinct words in ``w``, ascending: a count depends on the word alone."""
    import numpy as np

    return c[np.unique(w, return_index=True)[1]]


class _Part:
    """The bigrams of one part, of all blocks: distinct ones with training counts, and where each occurs.

    ``key``, ``count``, ``word_count``, ``history_count`` describe distinct bigrams; each block has ``sizes`` of them,
    at ``place``, ``times`` each, in the documents ``docs``.
    """

    @classmethod
    def merged(cls, train_texts: list[int], bigrams: list[bytes]) -> _Part:
        import numpy as np

        self = cls()
        keys, words, counts, histories, times, docs, trained = [], [], [], [], [], [], []
        for t, data in zip(train_texts, bigrams):
            dh, runs, ch, w, c, n, doc = _unpack(data)
            h, w = np.repeat(np.cumsum(dh, dtype="u4"), runs), _walked(w, runs)
            keys.append(h.astype("u8") << np.uint64(32) | w)
            words.append(np.unique(w))
            counts.append(c)
            histories.append(np.repeat(ch, runs))
            times.append(n)
            docs.append(doc)
            trained.append(np.add.reduceat((doc < t).astype("i8"), np.cumsum(n, dtype="i8") - n.astype("i8")))
        self.sizes = np.array([len(k) for k in keys], "u4")
        self.key, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.place, self.times, self.docs = place.astype("u4"), np.concatenate(times), np.concatenate(docs)
        self.history_count = np.concatenate(histories)[first]
        words, first = np.unique(np.concatenate(words), return_index=True)
        self.word_count = np.concatenate(counts)[first][np.searchsorted(words, (self.key & np.uint64(0xFFFFFFFF)).astype("u4"))]
        self.count = np.bincount(place, weights=np.concatenate(trained), minlength=len(self.key)).astype("u8")
        return self._grouped()

    @classmethod
    def unpacked(cls, data: bytes) -> _Part:
        import numpy as np

        self = cls()
        dh, runs, ch, w, c, self.count, self.sizes, place, self.times, self.docs = _unpack(data)
        w = _walked(w, runs)
        self.key = np.repeat(np.cumsum(dh, dtype="u4"), runs).astype("u8") << np.uint64(32) | w
        self.word_count, self.history_count = c[np.unique(w, return_inverse=True)[1]], np.repeat(ch, runs)
        self.place = _walked(place, self.sizes)  # steps start anew in each block
        return self._grouped()

    def packed(self) -> bytes:
        import numpy as np

        h, w = (self.key >> np.uint64(32)).astype("u4"), (self.key & np.uint64(0xFFFFFFFF)).astype("u4")
        first, runs = _runs(h)
        return _pack(
            np.diff(h[first], prepend=h.dtype.type(0)), runs, self.history_count[first], _steps(w, runs), _of_words(w, self.word_count),
            self.count, self.sizes, _steps(self.place, self.sizes), self.times, self.docs,
        )

    def _grouped(self) -> _Part:
        import numpy as np

        h = self.key >> np.uint64(32)
        self.first, runs = _runs(h)
        self.h, self.group = h[self.first], np.repeat(np.arange(len(self.first)), runs)
        return self

    def by_block(self, log):
        """For each block: the documents that occur here, and their sums of ``log`` (a value per distinct bigram)."""
        import numpy as np

        at = done = 0
        for n in self.sizes.tolist():
            times = self.times[at : at + n]
            doc = self.docs[done : done + int(times.sum())]
            total = np.bincount(doc, weights=np.repeat(log[self.place[at : at + n]], times))
            there = np.flatnonzero(np.bincount(doc))
            yield there, total[there]
            at, done = at + n, done + len(doc)

    def sums(self, uni: Unigrams):
        """For each history: counts held by bigrams of each count 1 to KATZ and above, and P(w) of all words seen after it."""
        import numpy as np

        level = np.minimum(self.count, KATZ + 1)
        held = np.stack([np.bincount(self.group, weights=np.where(level == r, self.count, 0).astype(float), minlength=len(self.h)) for r in range(1, KATZ + 2)], axis=1)
        seen = np.bincount(self.group, weights=np.where(self.count > 0, 10 ** uni.log(self.word_count), 0.0), minlength=len(self.h))
        return held, seen


def backoff(held, seen, total, d: list[float]):
    """log10 a(h) and the factor on a history's discounted counts, from its sums (rows of ``held``: counts by 1 to KATZ, above).

    A history whose counts are all above KATZ would leave nothing: all its counts then give up one in c(h) + 1.
    """
    import numpy as np

    held, seen, total = np.asarray(held, float), np.asarray(seen, float), np.asarray(total, float)
    spared = (held[:, :KATZ] * (1 - np.array(d))).sum(axis=1)
    factor = np.where(spared > 0, 1.0, total / (total + 1))
    free = np.where(spared > 0, spared / total, 1 / (total + 1))
    return np.log10(free / np.maximum(1 - seen, 1e-300)), factor


# -- 4: counts of counts, then scores ----------------------------------------


def _counted(rows: DataFrame, uni: Unigrams, spread: int, kind: str) -> DataFrame:
    """One row per part: its bigrams merged, the blocks they are of, counts of counts, and the sums of spread histories. Rows of documents pass."""
    hot = pa.list_(pa.struct([("h", pa.int64()), ("total", pa.int64()), ("held", pa.list_(pa.float64())), ("seen", pa.float64())]))
    names = ["part", "blocks", "bigrams", "low", "hot", "train_texts", "ids", "n_tokens", "n_known", "base", "score"]

    def run(table: pa.Table) -> pa.Table:
        blocks, train_texts = table.column("block").to_pylist(), table.column("train_texts").to_pylist()
        documents = [table.column(c) for c in names[6:]]
        if table.column("part")[0].as_py() < 0:
            return pa.table([table.column("part"), pa.array([[x] for x in blocks], pa.list_(pa.int64())), table.column("bigrams"), pa.array([None], pa.list_(pa.float64())), pa.array([None], hot), table.column("train_texts"), *documents], names=names)
        part = _Part.merged(train_texts, table.column("bigrams").to_pylist())
        low = [float((part.count == r).sum()) for r in range(1, KATZ + 2)]
        sums = []
        large = part.history_count[part.first] >= spread
        if large.any():
            held, seen = part.sums(uni)
            sums = [{"h": int(part.h[i]), "total": int(part.history_count[part.first[i]]), "held": held[i].tolist(), "seen": float(seen[i])} for i in large.nonzero()[0]]
        cols = [table.column("part")[:1], pa.array([blocks], pa.list_(pa.int64())), pa.array([part.packed()], pa.binary()), pa.array([low], pa.list_(pa.float64())), pa.array([sums], hot), pa.array([None], pa.int64()), *(pa.array([None], c.type) for c in documents)]
        return pa.table(cols, names=names)

    return rows.groupBy("part").applyInArrow(
        run,
        "part long, blocks array<long>, bigrams binary, low array<double>, hot array<struct<h long, total long, held array<double>, seen double>>, "
        f"train_texts long, ids array<{kind}>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>",
    )


#: Parts with spread histories up to this number get these by broadcast (a few kilobytes each); more are joined by shuffle.
BROADCAST_PARTS = 2_000


def _with_spread(parts: DataFrame, d: list[float]) -> DataFrame:
    """``blocks, bigrams, spread`` of ``parts``: the spread histories of each part (h, alpha, factor), from the sums of all parts that have a share."""
    shares = staged(parts.select("part", F.explode("hot").alias("x")).select("part", "x.*"), "spread")
    held = [F.sum(F.col("held")[r]).alias(f"held{r}") for r in range(KATZ + 1)]
    whole = shares.groupBy("h").agg(F.first("total").alias("total"), F.sum("seen").alias("seen"), *held)
    spared = sum((F.col(f"held{r}") * (1 - d[r]) for r in range(KATZ)), F.lit(0.0))
    whole = whole.withColumn("spared", spared)
    free = F.when(F.col("spared") > 0, F.col("spared") / F.col("total")).otherwise(1 / (F.col("total") + 1))
    factor = F.when(F.col("spared") > 0, 1.0).otherwise(F.col("total") / (F.col("total") + 1))
    rates = whole.select("h", F.log10(free / F.greatest(1 - F.col("seen"), F.lit(1e-300))).alias("alpha"), factor.alias("factor"))
    lists = shares.select("part", "h").join(rates, "h").groupBy("part").agg(F.collect_list(F.struct("h", "alpha", "factor")).alias("spread"))
    few = shares.select("part").distinct().count() <= BROADCAST_PARTS
    return parts.join(F.broadcast(lists) if few else lists, "part", "left").select("blocks", "bigrams", "spread")


def _scores(parts: DataFrame, uni: Unigrams, d: list[float]) -> DataFrame:
    """Per part and block: the documents' sums of log10 P(w | h) over the part's tokens. The parts are read where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for row in range(b.num_rows):
                part = _Part.unpacked(b.column(1)[row].as_py())
                held, seen = part.sums(uni)
                alpha, factor = backoff(held, seen, part.history_count[part.first], d)
                for x in b.column(2)[row].as_py() or ():
                    i = np.searchsorted(part.h, x["h"])
                    alpha[i], factor[i] = x["alpha"], x["factor"]
                with np.errstate(divide="ignore"):
                    direct = np.log10(_discounted(part.count, d) * factor[part.group] / part.history_count)
                log = np.where(part.count > 0, direct, alpha[part.group] + uni.log(part.word_count))
                out = [_pack(there.astype("u2"), sums.view("u8")) for there, sums in part.by_block(log)]
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0)[row].as_py(), pa.int64()), pa.array(out, pa.binary())], names=["block", "sums"])

    return parts.mapInArrow(run, "block long, sums binary")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD, order: int = 2) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Training takes rows whose crc32 of the id as text, mod 10, is not 0; ``held_out`` are the others. Tokens are runs
    without ASCII white space, A-Z in lower case, then one end. ``base_score`` sums log10((c + 0.1) / (N + 0.1 * (V + 1))).
    A null text is empty and has the end alone. A null id counts as the text '' (so it is held out). Repeated rows count
    each time. Without training rows every token is the unknown word, with probability 1. Other columns are left out.

    ``order`` is the length of the longest n-grams. Bigrams are counted in packed arrays, as above; longer ones take the
    plain form in ``katz_order``, which gives the same model and backs off as often as it has to.
    """
    if order != 2:
        from loomnote.llm import katz_order

        return katz_order.score(df, order, id_col, text_col)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    both = staged(_blocks(df, id_col, text_col), "blocks", "holds")
    blocks, dictionaries = both.where("holds = 'tokens'"), both.where("holds = 'words'")
    dictionaries.staged_at = f"{both.staged_at}/holds=words"
    texts, n_tokens = blocks.agg(F.coalesce(F.sum("train_texts"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // PART_TOKENS))
    known = staged(_merge_dictionaries(_dealt(dictionaries, parts), parts), "dictionary")
    discard(dictionaries)
    total = _totals(known.where("block = -1"))
    uni = Unigrams(total[0], total[1], texts, [0, *total[2:]])
    spread = max(spread, uni.tokens // (4 * parts))

    of_block = known.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "known")).alias("known"))  # a block's own dictionary
    table = staged(_counted(_bigrams(blocks.join(of_block, "block"), parts, uni, spread, kind), uni, spread, kind), "bigrams")
    discard(both, known)
    by_part = table.where("part >= 0")
    low = by_part.agg(*(F.coalesce(F.sum(F.col("low")[r]), F.lit(0)).cast("long") for r in range(KATZ + 1))).first()
    d = discounts([0, *low])

    def add(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = table.to_pylist()
        docs = next(r for r in rows if r["ids"] is not None)
        out = np.array(docs["score"])
        for r in rows:
            if r["sums"] is not None:
                there, sums = _unpack(r["sums"])
                out[there] += sums.view("f8")
        n, train = len(out), docs["train_texts"]
        ids = next(x for x in table.column("ids") if x.is_valid).values
        cols = [ids, pa.array([i >= train for i in range(n)]), pa.array(docs["n_tokens"], pa.int64()), pa.array(docs["n_known"], pa.int64()), pa.array([uni.tokens] * n, pa.int64()), pa.array(docs["base"], pa.float64()), pa.array(out)]
        return pa.table(cols, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    docs = table.where("part < 0").select(F.col("blocks")[0].alias("block"), "train_texts", "ids", "n_tokens", "n_known", "base", "score", F.lit(None).cast("binary").alias("sums"))
    none = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in ("train_texts", "ids", "n_tokens", "n_known", "base", "score")]
    sums = _scores(_with_spread(by_part, d), uni, d).select("block", *none, "sums")
    return docs.unionAll(sums).groupBy("block").applyInArrow(add, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
