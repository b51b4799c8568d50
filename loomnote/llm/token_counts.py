"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A word starts as its UTF-8 bytes in a doubly linked list. A heap holds every adjacent pair that the vocabulary
can merge, keyed by rank and then position; the lowest is popped and joined until none is left. Each join takes
one symbol away, so a word has ``bytes - joins`` tokens, and a text the sum over its words and special strings.
A word costs O(n log n) whatever its length. Words repeat, so each worker keeps a bounded table of counts; a full
table is emptied, which costs time and changes no result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnote.llm.bpe import Vocabulary, vocabulary

#: Words whose count a worker remembers.
REMEMBERED = 400_000


def count_word(word: bytes, v: Vocabulary) -> int:
    """Tokens of one word: its bytes less the merges."""
    n = left = len(word)
    if n < 2:
        return n
    merges = v.merges
    symbols = [v.byte_ids[b] for b in word]
    heap = []
    for i in range(n - 1):
        found = merges.get(symbols[i] << 20 | symbols[i + 1])
        if found:
            heap.append((found[0], i, found[1]))
    if not heap:
        return n
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while heap:
        _, i, joined = heappop(heap)
        j = after[i]
        # An entry is stale if its left symbol is gone or the pair there has changed since.
        if symbols[i] < 0 or j >= n or merges.get(symbols[i] << 20 | symbols[j], (0, -1))[1] != joined:
            continue
        symbols[i] = joined
        symbols[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            found = merges.get(joined << 20 | symbols[k])
            if found:
                heappush(heap, (found[0], i, found[1]))
        h = before[i]
        if h >= 0:
            found = merges.get(symbols[h] << 20 | joined)
            if found:
                heappush(heap, (found[0], h, found[1]))
    return left


class _Counts(dict):
    def __init__(self, v: Vocabulary):
        self.v = v

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = count_word(word.encode("utf-8"), self.v)
        if len(word) <= 64:
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str):
    """``text -> tokens``, with special strings in the text counted as one token each, as the tokenizer does by default."""
    v = vocabulary(path)
    words, count = regex.compile(v.pattern), _Counts(v).__getitem__
    specials = regex.compile("|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True))) if v.special else None

    def tokens(text: str) -> int:
        if specials is None or not specials.search(text):
            return sum(map(count, words.findall(text)))
        parts = specials.split(text)
        return len(parts) - 1 + sum(sum(map(count, words.findall(p))) for p in parts)

    return tokens


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row of ``df``: its UTF-8 bytes and tokens, and whether they exceed ``limit``.

    A null text counts as empty: 0 bytes and tokens. A null id stays null. Repeated rows each get a row. Other
    columns are left out, so their names cannot clash. One narrow pass: no shuffle, nothing gathered.
    ``path`` names a vocabulary file that every worker can open.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            n = [tokens(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("n_bytes"), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
