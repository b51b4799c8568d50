import random
import re
from collections import defaultdict

from loomnote.llm.quotations import link

SCHEMA = "conv_id long, turn long, role string, text string, part int, lines string"


def brute(rows):
    """Parent and reply order of each turn by walking each conversation."""

    def lines(text):
        out = []
        for x in re.split("\r\n|\n|\r", text or ""):
            m = re.match(r"(?:[ \t]*>)*", x).group()
            out.append((m.count(">"), " ".join(re.sub("^[ \t]", "", x[len(m) :]).lower().split())))
        return [x for i, x in enumerate(out) if not (re.match(r"on\b.*\bwrote\s*:$", x[1]) and i + 1 < len(out) and out[i + 1][0] > x[0])]

    convs = defaultdict(lambda: defaultdict(list))
    for c, t, _, text in rows:
        if c is not None and t is not None:
            convs[c][t].append(lines(text))
    out = {}
    for c, turns in convs.items():
        said = {}
        for t in sorted(turns):
            for m in turns[t]:
                for level, x in m:
                    if level == 0 and x:
                        said.setdefault(x, t)
        parent, children, before = {}, defaultdict(list), None
        for t in sorted(turns):
            found = []
            for m in turns[t]:
                votes = defaultdict(int)
                for level, x in m:
                    if level == 1 and x and said.get(x, t) < t:
                        votes[said[x]] += 1
                if votes:
                    found.append(max((n, o) for o, n in votes.items())[1])
            parent[t] = max(found) if found else before
            children[parent[t]].append(t)
            before = t
        order, stack = [], [(t, 0) for t in reversed(children[None])]
        while stack:
            t, d = stack.pop()
            out[c, t] = (parent[t], len(order), d)
            order.append(t)
            stack += [(x, d + 1) for x in reversed(children[t])]
    return out


def check(spark, rows):
    got = link(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.parent_turn, r.position, r.depth) == want.get((r.conv_id, r.turn), (None, 0, 0)), r
    return got


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nI lost it."),
        (1, 1, "assistant", "Under the mat."),
        (1, 2, "user", "On Monday, A wrote:\n> where is  THE key?\n> I lost it.\nAny news?"),
        (1, 3, "user", "> > Where is the key?\n> Under the mat.\nThanks"),
        (1, 4, "user", ">> Where is the key?\n>> I lost it.\n> Any news?\nYes"),
        (1, 5, "user", "> never said\nhm"),
    ]
    got = {r.turn: r for r in check(spark, rows)}
    assert [got[t].parent_turn for t in range(6)] == [None, 0, 0, 1, 2, 4]
    assert [got[t].linked_by for t in range(6)] == ["start", "order", "quote", "quote", "quote", "order"]
    assert [got[t].position for t in range(6)] == [0, 1, 3, 2, 4, 5]
    assert got[2].clean == "Any news?" and got[3].clean == "Thanks" and got[4].clean == "Yes" and got[4].max_level == 2
    assert (got[2].n_quoted, got[2].n_found, got[5].n_quoted, got[5].n_found) == (2, 2, 1, 0)


def test_random_conversations(spark):
    rng = random.Random(6)
    rows = []
    for c in range(12):
        said = []
        for t in range(1 if c == 0 else rng.randint(2, 30)):
            own = [rng.choice(["Hi", f"line {c} {t}", "common line"]) for _ in range(rng.randint(0, 3))]
            quote = ["> " + x for x in rng.choice(said)] if said and rng.random() < 0.6 else []
            rows.append((c, t * rng.choice([1, 1, 3]) if c % 3 else t, "user", "\n".join(quote + own)))
            said.append(own)
    check(spark, rows)


def test_edges(spark):
    rows = [(None, 1, "user", "> a"), (1, None, "user", "b"), (2, 5, None, None), (2, 5, "user", "x"), (2, 5, "user", "x"), (2, 9, "user", "> x\n" + "long " * 50000), (3, -4, "user", ""), (3, 7000, "user", "> \n>\n"), (3, 2000, "user", "z")]
    check(spark, rows)
    assert link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    check(spark, [(1, t, "user", f"line {t}" + (f"\n> line {t - 7}" if t % 5 == 0 else "")) for t in range(2500)])


def test_deeper_levels_find_their_origins(spark):
    rows = [
        (1, 0, "user", "Where is the key?"),
        (1, 1, "assistant", "Under the mat."),
        (1, 2, "user", "aside"),
        (1, 3, "user", ">> Where is the key?\nlevel 1 is cut away"),
        (1, 4, "user", "> never said\n>> Under the mat.\n>>> Where is the key?"),
        (1, 5, "user", "> aside\n>> Under the mat."),
    ]
    got = {r.turn: r for r in link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[t].parent_turn, got[t].linked_by, got[t].link_level) for t in (2, 3, 4, 5)] == [(1, "order", None), (0, "quote", 2), (1, "quote", 2), (2, "quote", 1)]
    assert [(got[t].n_quoted, got[t].n_found, got[t].n_deeper, got[t].n_deeper_found) for t in (3, 4, 5)] == [(0, 0, 1, 1), (1, 0, 2, 2), (1, 1, 1, 1)]
    assert [tuple(x) for x in got[4].origins] == [(2, 1, 1), (3, 0, 1)] and got[2].origins == []


def test_whole_passages_come_from_the_latest_turn(spark):
    """Also over ranges of turns: 3 and 1500 say "Thanks!", 1501 and 1502 quote it."""
    said = {1: "A", 2: "B", 3: "Thanks!", 5: "A\n\nB", 6: "> a\n> B\nC", 7: "> Thanks!\nwelcome", 1500: "Thanks!", 1501: "> thanks!", 1502: ">> Thanks!", 1503: "Thanks!\nBye\nSee you", 1504: "> Thanks!\n> Bye", 1505: "> A\n>> C\n> B"}
    rows = [(c, t, "user", x) for c in (1, 2) for t, x in said.items()] + [(2, 1499, "user", "A\nB")]
    got = {(r.conv_id, r.turn): r for r in link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), whole=True).collect()}
    want = {6: 5, 7: 3, 1501: 1500, 1502: 1500, 1504: 1503}
    assert {(c, t): got[c, t].parent_turn for c in (1, 2) for t in want} == {(c, t): o for c in (1, 2) for t, o in want.items()}
    assert [tuple(x) for x in got[1, 1505].origins] == [(1, 2, 1), (2, 6, 1)]
    assert got[1, 6].n_found == 2 and got[1, 3].linked_by == "order"
