"""Ignore rules in gitignore syntax, compiled on the driver to one Column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str  # matches a path, or a folder above it
    negated: bool


def _segment(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", r"\\")
            out += f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_rules(text: str) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        folder = line.endswith("/")
        body = line.rstrip("/")
        if not body:
            continue
        anchored = "/" in body
        parts = body.strip("/").split("/")
        pattern = "^" if anchored else "(?:^|/)"
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                pattern += ".*" if last else "(?:.*/)?"
            else:
                pattern += _segment(part) + ("" if last else "/")
        # A rule for a folder matches what is below it; one for a file matches it, or a folder of that name.
        rules.append(Rule(pattern + ("/" if folder else "(?:/|$)"), negated))
    return rules


def ignores(path: Column, rules: list[Rule]) -> Column:
    """Whether the rules ignore a file: the last rule that matches decides. Absolute paths and paths with .. are never ignored."""
    out = F.lit(False)
    for rule in rules:
        out = F.when(path.rlike(rule.pattern), F.lit(not rule.negated)).otherwise(out)
    outside = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike(r"^[A-Za-z]:[\\/]")
    return ~outside & out
