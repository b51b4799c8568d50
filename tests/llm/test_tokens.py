import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomnote.llm.packing import RoomTree, best_fit_plan, pack
from loomnote.llm.token_counts import counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, length int"
TEXTS = [None, "", " ", "a", "hello  world\n\n it's fine", "x" * 5000, "é" * 3000, "<|endoftext|>ab<|endoftext|>", "\x1c\x85  ​", "数据処理" * 50, "word " * 9000, "a", "a", "1234 !!?? \t\t x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab 's\n\t'ret<|endoftx>é1", max_size=60))
def test_counts_equal_the_library(text):
    assert counter(PATH)(text) == len(test_counts_equal_the_library.library.encode(text, add_special_tokens=False).ids)


test_counts_equal_the_library.library = Tokenizer.from_file(PATH)


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


def test_token_counts_rows(spark, library):
    rows = token_counts(frame(spark, TEXTS), PATH, limit=100).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[3 if r.doc_id is None else r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts(frame(spark, []), PATH).count() == 0


def test_room_tree():
    rng = random.Random(1)
    for size in (1, 5, 64, 100):
        tree, held = RoomTree(size), defaultdict(int)
        for _ in range(300):
            r = rng.randint(0, size)
            n = rng.choice([1, -1]) if held[r] else 1
            held[r] += n
            tree.add(r, n)
            need = rng.randint(0, size)
            assert tree.tightest(need) == min((k for k, v in held.items() if v and k >= need), default=-1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=80), st.just(32))
def test_plan_equals_one_by_one_best_fit(lengths, size):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    plan, windows = best_fit_plan(counts, size)
    rooms, filled = [], defaultdict(list)
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        r = min(fits) if fits else size
        if fits:
            rooms.remove(r)
        rooms.append(r - x)
    assert windows == len(rooms)
    for length, lo, hi, each, first, at in plan:
        for i in range(hi - lo):
            filled[first + i // each].append((at + i % each * length, length))
    assert sum(map(len, filled.values())) == len(lengths)
    for parts in filled.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= size
    assert sorted(size - sum(x for _, x in p) for p in filled.values()) == sorted(rooms)


def test_pack_rows(spark, library):
    size = 64
    rows = pack(frame(spark, TEXTS), PATH, size=size).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(TEXTS):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by_doc[i if i != 3 else None], key=lambda r: r.start)
        assert [r.start for r in got] == list(range(0, len(ids), size))
        for r in got:
            part = ids[r.start : r.start + size]
            assert (r.length, r.ids_crc32, r.doc_tokens) == (len(part), zlib.crc32(part.tobytes()), len(ids))
    for parts in by_window.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= size
    assert pack(frame(spark, []), PATH).count() == 0
