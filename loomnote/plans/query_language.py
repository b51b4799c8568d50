"""The keyword query language: text to a parsed query. Runs on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ParsedQuery:
    terms: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    title: tuple[str, ...] = ()
    path: tuple[str, ...] = ()
    in_folder: str | None = None
    links: str | None = None
    related: str | None = None
    is_orphan: bool = False
    raw: str = ""

    @property
    def is_empty(self) -> bool:
        return self.is_filter_only and not (self.exclude or self.in_folder or self.links or self.related or self.is_orphan)

    @property
    def is_filter_only(self) -> bool:
        return not (self.terms or self.phrases or self.title or self.path)

    def describe(self) -> str:
        """The query in words; exclusions last."""
        held = {"title": self.title, "path": self.path, "in_folder": [self.in_folder], "links": [self.links], "related": [self.related], "exclude": self.exclude}
        filters = [SAID[name].format(value) for name in SAID if name in held and name != "exclude" for value in held[name] if value]
        said = [" + ".join(self.terms)] if self.terms else []
        said += [f'"{p}"' for p in self.phrases] + filters + ([SAID["is_orphan"]] if self.is_orphan else [])
        return ", ".join(said + [SAID["exclude"].format(x) for x in self.exclude])


#: How filters read (fixed values).
SAID = {
    "title": "title has {}",
    "path": "path has {}",
    "in_folder": "in {}/",
    "links": "links to {}",
    "related": "related to {}",
    "is_orphan": "unlinked",
    "exclude": "not {}",
}

#: A token: characters that are no white space, and quoted runs, the last of which may be open.
_TOKEN = re.compile(r'(?:[^\s"]|"[^"]*(?:"|$))+')
#: What a token has up to the end of its first quoted run.
_HEAD = re.compile(r'[^"]*"[^"]*')


def split_tokens(raw: str) -> list[tuple[str, bool]]:
    """Words and whether each counts as quoted. White space splits; quotes group, and are part of the token they touch.

    A token is quoted if it has a quoted run and no colon up to the end of the first: after a colon, quotes only hold
    the value together.
    """
    found = []
    for token in _TOKEN.findall(raw):
        head = _HEAD.match(token)
        found.append((token.replace('"', ""), head is not None and ":" not in head.group()))
    return [(text, quoted) for text, quoted in found if text]


def parse_query(raw: str) -> ParsedQuery:
    """Phrases keep their case, for display; they are matched without regard to it."""
    q = ParsedQuery(raw=raw)
    for text, quoted in split_tokens(raw):
        if quoted:
            q = replace(q, phrases=(*q.phrases, text))
        elif text[0] == "-" and len(text) > 1:
            q = replace(q, exclude=(*q.exclude, text[1:].lower()))
        elif text.find(":") > 0 and (operated := _operated(q, *text.split(":", 1))):
            q = operated
        else:
            q = replace(q, terms=(*q.terms, text.lower()))
    return q


def _operated(q: ParsedQuery, key: str, value: str) -> ParsedQuery | None:
    """``q`` with an operator applied; None if it is none, or lacks its value."""
    key = key.lower()
    if not value:
        return None
    if key == "is":
        return replace(q, is_orphan=True) if value.lower() == "orphan" else None
    if key in ("title", "path"):
        return replace(q, **{key: (*getattr(q, key), value.lower())})
    if key == "in":
        return replace(q, in_folder=value.replace("\\", "/").rstrip("/"))
    if key in ("links", "related"):
        return replace(q, **{key: value})
    return None
