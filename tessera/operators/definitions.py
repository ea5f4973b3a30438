"""Definitions in source code of brace languages: a lexer by tables, a nesting of brackets, and rules on each level.

A source becomes tokens (comments and preprocessor lines go, strings are one token), brackets nest
them into a tree, and each level of the tree is told as a line of its tokens in which a nested bracket is just
its pair. On such lines the definitions of a language are regular, so a few patterns name them.
Code whose brackets don't match has no tree.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

SCRIPTS = ("JavaScript", "JavaScript (React)", "TypeScript", "TypeScript (React)")
LANGUAGES = (*SCRIPTS, "Java", "Go", "Rust", "C", "C++")


class Broken(ValueError):
    """Brackets, strings or comments that don't end."""


@dataclass
class Item:
    """A token, or a bracket with what is in it."""

    text: str
    start: int
    end: int
    fresh: bool  # first on its line
    items: list[Item] = field(default_factory=list)


@dataclass(frozen=True)
class Definition:
    kind: str
    name: str
    start: int
    end: int
    members: tuple[Definition, ...] = ()


# -- tokens

_QUOTED, _TICKED = r'"(?:\\[\s\S]|[^"\\\n])*"', r"'(?:\\[\s\S]|[^'\\\n])*'"
_STRINGS = {
    "Java": rf'"""(?:\\[\s\S]|[^\\])*?"""|{_QUOTED}|{_TICKED}',
    "Go": rf"`[^`]*`|{_QUOTED}|{_TICKED}",
    # a quote and a name without a closing quote is a lifetime
    "Rust": rf"b?r(?P<hash>#*)\"[\s\S]*?\"(?P=hash)|b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\u\{{\w*\}}|\\x\w\w|\\.|[^'\\\n])'|'\w+",
    "C": rf"(?:u8|[uUL])?(?:{_QUOTED}|{_TICKED})",
    "C++": rf'(?:u8|[uUL])?(?:R"(?P<mark>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=mark)"|{_QUOTED}|{_TICKED})',
} | {x: f"{_QUOTED}|{_TICKED}" for x in SCRIPTS}
_DIRECTIVE = r"(?m:^)[ \t]*#(?:\\\r?\n|/\*[\s\S]*?\*/|[^\n])*"
_LEXERS = {
    x: re.compile(rf"(?P<skip>//[^\n]*|/\*|{_DIRECTIVE if x in ('C', 'C++') else '(?!)'})|(?P<text>{s})|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|->|::|[^\s\w])")
    for x, s in _STRINGS.items()
}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: After these a slash of a script divides; after anything else it begins a pattern.
_VALUE_ENDS = re.compile(r"[\w$)\]}\"'`]$")
_NO_VALUE = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "instanceof", "yield", "await"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _comment_end(source: str, at: int, nested: bool) -> int:
    depth, i = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(source, i):
        depth += 0 if m[0] == "/*" and not nested else 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    raise Broken("a comment doesn't end")


def _template_end(source: str, at: int, language: str) -> int:
    """The end of a template string, whose parts in ``${}`` are code again."""
    i = at + 1
    while i < len(source):
        if source[i] == "`":
            return i + 1
        if source.startswith("${", i):
            for token in _tokens(source, language, i + 2, inside=True):
                i = token.end
        else:
            i += 2 if source[i] == "\\" else 1
    raise Broken("a template doesn't end")


def _tokens(source: str, language: str, at: int = 0, inside: bool = False) -> Iterator[Item]:
    """Tokens from ``at`` on; ``inside``: up to the brace that closes what was open there."""
    lexer, script, depth, last = _LEXERS[language], language in SCRIPTS, 0, ""
    line = source.rfind("\n", 0, at) + 1
    done = line  # the place up to which tokens have been told
    while m := lexer.search(source, at):
        kind, text, at = m.lastgroup if m.lastgroup not in ("hash", "mark") else "text", m[0], m.end()
        if kind == "skip":
            at = _comment_end(source, m.start(), language == "Rust") if text.startswith("/*") else at
            continue
        if script and text == "`":
            at, text = _template_end(source, m.start(), language), '""'
        elif script and text == "/" and (not _VALUE_ENDS.search(last) or last in _NO_VALUE) and (found := _PATTERN.match(source, m.start())):
            at, text = found.end(), '""'
        elif kind == "text":
            text = "'" if language == "Rust" and text[0] == "'" and not text.endswith("'") else '""'
        yield Item(text, m.start(), at, "\n" in source[done : m.start()] or not done)
        done, last = at, text
        if inside:
            depth += (text == "{") - (text == "}")
            if depth < 0:
                return
    if inside:
        raise Broken("a template doesn't end")


def tree(source: str, language: str) -> list[Item]:
    """The tokens of a source, nested by its brackets; raises Broken."""
    stack = [Item("", 0, len(source), True)]
    for token in _tokens(source, language):
        if token.text in _PAIRS:
            stack.append(token)
        elif token.text in _PAIRS.values():
            group = stack.pop()
            if not stack or _PAIRS[group.text] != token.text:
                raise Broken(f"no match for {token.text} at {token.start}")
            group.text, group.end = group.text + token.text, token.end
            stack[-1].items.append(group)
        else:
            stack[-1].items.append(token)
    if len(stack) > 1:
        raise Broken(f"no match for {stack[-1].text} at {stack[-1].start}")
    return stack[0].items


# -- rules: (pattern of a level's line, kind); group ``name`` names it, ``at`` begins it if that isn't the pattern's begin; a kind "" is no definition

_N = r"(?P<name>[^\W\d][\w$]*|\$[\w$]*)"
_W = r"(?:[^\W\d][\w$]*|\$[\w$]*)"
_ANY = r"[^;{}]*"
_ANGLES = r"<(?:[^<>;{}]|\{\}|<(?:[^<>;{}]|\{\}|<[^<>;{}]*>)*>)*>\s"
_NOTES = rf"(?:@\s(?!interface\b){_W}(?:\s\.\s{_W})*\s(?:\(\)\s)?)*"
#: The rest of a statement of a language that ends them by line; operators carry it on.
_LINE = r"(?:[^;\n]|\n(?=[.,+*/?:&|=<>%^])|(?<=[.,+*/?:&|=<>%^])\n)*;?"
_RESULT = rf"(?::\s(?:\{{\}}\s)?{_ANY})?\{{\}}"
_JAVA = rf"(?:{_NOTES.removesuffix('*')}|(?:public|private|protected|static|final|abstract|sealed|strictfp|synchronized|native|default|transient|non\s-\ssealed)\s)*"
_RUST = r"(?:#\s\[\]\s)*(?:pub\s(?:\(\)\s)?)?"
_C_NAME = rf"(?P<name>~?\s?{_W}|operator\s?(?:\(\)|[^\w(;{{}}]+?|{_W}))"
_C_FUNCTION = rf"(?!(?:typedef|using|return|else|namespace|template|extern\s\"\"\s\{{)\b)(?:[^\W\d][^;{{}}=()]*?[\s*&])?(?:{_W}\s(?:<{_ANY}>\s)?::\s)*{_C_NAME}\s\(\)(?:\s(?!\(\))[^;{{}}=:]*)?(?:\s(?:\(\)|→)[^;{{}}=:]*)?(?:\s:\s(?:[^;{{}}]|\{{\}}(?=\s[,{{]))*)?\s?"
_TEMPLATE = (rf"template\s<{_ANY}>{_ANY}(?:\{{\}}(?:\s;)?|;)", "")
_C_CLASS = rf"\s(?:[A-Z_0-9]+\s(?:\(\)\s)?)?{_N}\s(?:final\s)?(?::\s{_ANY})?\{{\}}(?=\s;)"
_SCRIPT = (
    (rf"export\s(?:[^;{{}}\n]*\{{\}}(?:\sfrom\s\"\")?(?:\s\{{\}})?|{_LINE})", ""),
    (rf"(?:async\s)?function\s(?:\*\s)?{_N}\s(?:{_ANGLES})?\(\)\s{_RESULT}", "function"),
    (rf"{_NOTES}(?:abstract\s)?class\s{_N}\s{_ANY}\{{\}}", "class"),
    (rf"(?:const|let)\s(?!enum\b)(?:{_N}|\[\]|\{{\}}){_LINE}", "variable"),
)
_TYPED = (*_SCRIPT, (rf"interface\s{_N}\s{_ANY}\{{\}}", "interface"))
RULES = {
    "JavaScript": _SCRIPT, "JavaScript (React)": _SCRIPT, "TypeScript": _TYPED, "TypeScript (React)": _TYPED,
    "Java": ((rf"{_JAVA}class\s{_N}\s{_ANY}\{{\}}", "class"), (rf"{_JAVA}interface\s{_N}\s{_ANY}\{{\}}", "interface")),
    "Go": (
        (rf"func\s{_N}\s(?:\[\]\s)?\(\)(?:[^;{{}}\n]*\b(?:interface|struct)\s\{{\}})*[^;{{}}\n]*\{{\}}", "function"),
        (rf"func\s\(\)\s{_N}\s\(\)(?:[^;{{}}\n]*\b(?:interface|struct)\s\{{\}})*[^;{{}}\n]*\{{\}}", "method"),
        (rf"type\s(?:\(\)|{_N}[^;\n]*)", "type"),
    ),
    "Rust": (
        (rf"{_RUST}(?:(?:async|unsafe|const|extern(?:\s\"\")?)\s)*fn\s{_N}\s{_ANY}\{{\}}", "function"),
        (rf"{_RUST}struct\s{_N}\s{_ANY}(?:\{{\}}|;)", "struct"),
        (rf"{_RUST}enum\s{_N}\s{_ANY}\{{\}}", "enum"),
        (rf"{_RUST}(?:unsafe\s)?trait\s{_N}\s{_ANY}\{{\}}", "trait"),
        (rf"(?:#\s\[\]\s)*(?:unsafe\s)?impl\s(?:{_ANGLES})?(?:!\s)?(?:{_W}\s::\s)*{_N}\s{_ANY}\{{\}}", "impl"),
    ),
    "C": ((rf"struct{_C_CLASS}", "struct"), (rf"{_C_FUNCTION}\{{\}}", "function")),
    "C++": (_TEMPLATE, (rf"class{_C_CLASS}", "class"), (rf"struct{_C_CLASS}", "struct"), (rf"{_C_FUNCTION}\{{\}}", "function")),
}
_SCRIPT_MEMBER = ((rf"{_NOTES}(?:(?:static|async|get|set|public|private|protected|readonly|override)\s)*(?:\*\s)?(?:#\s)?(?:{_N}|\[\]|\"\")\s(?:\?\s)?(?:{_ANGLES})?\(\)\s{_RESULT}", "method"),)
#: What is split into members, and by which rules.
MEMBERS = {(x, "class"): _SCRIPT_MEMBER for x in SCRIPTS} | {
    ("Java", "class"): ((rf"{_JAVA}(?:{_ANGLES})?(?:(?!(?:new|return|throw|else)\b)[\w$.<>,?&\[\]@\s]+?\s)?{_N}\s\(\)\s(?:\[\]\s)?(?:throws\s{_ANY})?(?:\{{\}}|;)", "method"),),
    ("Rust", "impl"): ((rf"{_RUST}(?:(?:async|unsafe|const|default|extern(?:\s\"\")?)\s)*fn\s{_N}\s{_ANY}\{{\}}", "method"),),
    ("C++", "class"): (_TEMPLATE, (rf"{_C_FUNCTION}(?:\{{\}}|=\s(?:default|delete)\s;)", "method")),
}
MEMBERS["C++", "struct"] = MEMBERS["C++", "class"]
_LINES = {r: re.compile(r[0]) for rules in (*RULES.values(), *MEMBERS.values()) for r in rules}
#: A token after which a line goes on.
_OPEN = re.compile(r"[.,+*/?:&|=<>%^→-]$")


def _level(items: list[Item], language: str, rules: tuple) -> list[Definition]:
    """The definitions that ``rules`` find among the items of a level."""
    line, places = "", []
    for x in items:
        line += ("\n" if x.fresh else " ") if line else ""
        places.append(len(line))
        line += "→" if x.text in ("=>", "->") else x.text
    line += " "
    out, i = [], 0
    while i < len(items):
        m, kind = next(((m, r[1]) for r in rules if (m := _LINES[r].match(line, places[i]))), (None, ""))
        begin = i
        if m:
            i = bisect_right(places, max(m.end() - 1, places[i])) - 1
            if line[places[i] : m.end()].strip() == "":  # the match ends between two tokens
                i -= 1
            i = max(i, begin)
        if m and kind:
            own = items[begin : i + 1]
            body = next((x for x in reversed(own) if x.text == "{}"), None)
            members = MEMBERS.get((language, kind))
            name = m["name"] or next((x.text for g in own if g.text in ("()", "{}", "[]") for x in g.items if re.match(_W, x.text)), "")
            found = _level(body.items, language, members) if members and body else []
            out.append(Definition(kind, re.sub(r"\s", "", name), own[0].start, own[-1].end, tuple(found)))
        i += 1
        # the next statement begins after its end, or on a line that nothing carries on; what was matched has ended
        while not m and i < len(items):
            before = items[i - 1].text
            if before in (";", "{}") or (items[i].fresh and not _OPEN.search(before)) or (before == ":" and i > 1 and items[i - 2].text in ("public", "private", "protected")):
                break
            i += 1
    return out


def find(source: str, language: str) -> list[Definition]:
    """The definitions of a source's outermost level with their members, in order; raises Broken where its brackets don't match.

    Exported declarations of scripts, templates, namespaces and modules are no definitions, nor is what is in them;
    annotations, decorators and attributes belong to theirs. A C function is named by its declarator.
    """
    return _level(tree(source, language), language, RULES[language])
