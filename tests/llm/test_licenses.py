import random
import re
import time

from pyspark.sql import functions as F

from loomnote.llm.licenses import PHRASES, TEMPLATES, notices, scan, scan_words

SCHEMA = "doc_id long, text string, words string, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def base(text):
    words = WORD.findall(lower(text or ""))
    places = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def brute(text, k=3, near=3, cover=0.8, longest=1.5):
    """Labels of notices by the same rule, position by position."""
    words, out = WORD.findall(lower(text or "")), set()
    for label, template in TEMPLATES:
        t = WORD.findall(lower(template))
        hits = {}
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    hits.setdefault(i - j, []).append((i, j))
        group, last = [], None
        for d in [*sorted(hits), None]:
            if last is not None and (d is None or d - last > near):
                ats, places = {i + x for i, _ in group for x in range(k)}, {j + x for _, j in group for x in range(k)}
                if min(len(ats), len(places)) >= cover * len(t) and max(ats) - min(ats) + 1 <= longest * len(t):
                    out.add(label)
                group = []
            if d is not None:
                group += hits[d]
            last = d
    return out


def texts():
    rng = random.Random(4)
    filler = ["lorem", "É", "cc", "by", "all", "rights", "license", "version", "2", "the", "under"]
    out = [None, "", "!!", "CC-BY", "cc by cc BY, All RIGHTS reserved. general public license", "ccby", "all rights  reserved" * 3, "word " * 30000 + TEMPLATES[0][1]]
    for _, t in TEMPLATES:
        words = t.split()
        cut = words[:]
        cut.insert(len(cut) // 2, "really")
        swapped = words[:]
        swapped[len(words) // 2] = "Ünlike"
        out += [t, t.upper(), " ".join(cut), " ".join(swapped), " ".join(words[: len(words) // 2]), f"{' '.join(rng.choices(filler, k=20))} {t} {' '.join(rng.choices(filler, k=9))} {t}"]
    return out + [" ".join(rng.choices(filler, k=40)) for _ in range(30)] + [TEMPLATES[0][1]]


def test_scan(spark):
    data = texts()
    df = spark.createDataFrame([(i if i != 5 else None, t, "clash", "clash") for i, t in enumerate(data)], SCHEMA)
    rows = scan(df).collect()
    assert len(rows) == len(data)
    for r in rows:
        text = data[5 if r.doc_id is None else r.doc_id]
        want = base(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, text
        more = brute(text)
        assert r.labels == ",".join(sorted(set(filter(None, want[4].split(","))) | more)), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and (r.n_notices > 0) == bool(more)
    assert scan(df.limit(0)).count() == 0


def test_spans_and_repeated_ids(spark):
    notice = TEMPLATES[8][1]
    df = spark.createDataFrame([(1, f"a b {notice} c", "", ""), (1, "other text", "", ""), (1, f"a b {notice} c", "", "")], SCHEMA)
    span = notices(df).collect()
    assert [(r.doc_id, r.label, r.first_word, r.last_word, r.coverage) for r in span] == [(1, "mit", 2, 6, 1.0)]
    assert sorted(r.labels for r in scan(df).collect()) == ["", "mit", "mit"]


def test_words_of_odd_texts(spark):
    rng = random.Random(6)
    letters = [*map(chr, range(128)), *"abcXYZ019 " * 12, "É", "é", "İ", "ß", "\x85", "\xa0", "\u2003", "\u212a", "\U0001f600"]
    data = ["", " ", "a", "é", "A ", " A", "\x00", "a\n", "É!É", *("".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(500))]
    rows = spark.createDataFrame(list(enumerate(data)), "i int, text string").select("i", scan_words(F.col("text")).alias("words")).collect()
    assert {r.i: r.words for r in rows} == {i: WORD.findall(lower(t)) for i, t in enumerate(data)}


def test_words_cost_less_than_extracting_them(spark):
    texts = spark.range(8000).repartition(8).select(F.concat(F.repeat(F.lit("Lorem, ipsum "), 200), F.col("id").cast("string")).alias("text")).localCheckpoint()

    def seconds(words):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            texts.select(F.size(words)).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return min(took)

    extracted = F.regexp_extract_all(F.lower("text"), F.lit(WORD.pattern), F.lit(0))
    assert seconds(scan_words(F.col("text"))) < 0.7 * seconds(extracted)
