import pytest

from loomnote.plans.query_language import ParsedQuery, parse_query


@pytest.mark.parametrize(
    "raw, want",
    [
        ('tea "wet ink" -coffee title:page in:desk/ is:orphan', dict(terms=("tea",), phrases=("wet ink",), exclude=("coffee",), title=("page",), in_folder="desk", is_orphan=True)),
        ('title:"wet ink"', dict(title=("wet ink",))),
        ('"wet ink', dict(phrases=("wet ink",))),
        ('"has: colon"', dict(terms=("has: colon",))),
        ('"Wet Ink" page', dict(phrases=("Wet Ink",), terms=("page",))),
        ('"title:wet ink"', dict(title=("wet ink",))),
        ('loose"leaf tea"', dict(phrases=("looseleaf tea",))),
        ('"loose l"eaf', dict(phrases=("loose leaf",))),
        ('"" tea', dict(terms=("tea",))),
        ('tea "', dict(terms=("tea",))),
        ('in:"old tea"', dict(in_folder="old tea")),
        ("-title:x", dict(exclude=("title:x",))),
        ("-", dict(terms=("-",))),
        ("foo:bar", dict(terms=("foo:bar",))),
        ("title:", dict(terms=("title:",))),
        (":x", dict(terms=(":x",))),
        ("is:lost", dict(terms=("is:lost",))),
        ("in:a\\b/ in:c", dict(in_folder="c")),
        ("links:Note related:Other", dict(links="Note", related="Other")),
        ("PATH:Desk Tea", dict(path=("desk",), terms=("tea",))),
        ('one"two three"four', dict(phrases=("onetwo threefour",))),
        ('key:"a b" c', dict(terms=("key:a b", "c"))),
        ("   ", {}),
    ],
)
def test_parse(raw, want):
    assert parse_query(raw) == ParsedQuery(raw=raw, **want)


def test_kinds():
    assert parse_query("").is_empty and parse_query("in:/").is_empty
    assert parse_query("-x").is_filter_only and not parse_query("-x").is_empty
    assert not parse_query("path:a").is_filter_only
    assert parse_query('b "c d" in:x is:orphan -e').describe() == 'b, "c d", in x/, unlinked, not e'
    assert parse_query("tea pot title:a path:b links:c related:d").describe() == "tea + pot, title has a, path has b, links to c, related to d"
