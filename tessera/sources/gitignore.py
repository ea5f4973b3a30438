"""Ignore patterns: compiled on the driver to regular expressions, matched on paths."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    folders_only: bool


def _translate(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.+")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def parse(lines: list[str]) -> list[Rule]:
    """Rules of an ignore file; blank lines and comments are none."""
    rules = []
    for line in lines:
        line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = _translate(line.lstrip("/"))
        rules.append(Rule(("" if anchored else "(?:.*/)?") + body, negated, folders))
    return rules


class Ignore:
    """Whether a path is ignored: the last rule that matches decides; what lies in an ignored folder stays ignored."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = [(re.compile(r.regex), r.negated, r.folders_only) for r in rules]

    def _one(self, path: str, folder: bool) -> bool:
        out = False
        for regex, negated, folders_only in self.rules:
            if (folder or not folders_only) and regex.fullmatch(path):
                out = not negated
        return out

    def ignored(self, path: str, folder: bool = False) -> bool:
        parts = path.strip("/").split("/")
        if any(self._one("/".join(parts[:i]), True) for i in range(1, len(parts))):
            return True
        return self._one("/".join(parts), folder)


def from_text(text: str | None) -> Ignore | None:
    """None if there is nothing to ignore by."""
    rules = parse(text.splitlines()) if text else []
    return Ignore(rules) if rules else None


def find_root(paths: list[str]) -> str | None:
    """The ignore file among relative paths: at the root, or in the only folder of the root."""
    if ".gitignore" in paths:
        return ".gitignore"
    tops = {p.split("/")[0] for p in paths}
    if len(tops) == 1 and (found := f"{next(iter(tops))}/.gitignore") in paths:
        return found
    return None
