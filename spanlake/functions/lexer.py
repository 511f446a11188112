"""A lexer for languages of brace blocks: which characters are code, and where blocks and statements end."""

from __future__ import annotations

import re

# Words and characters after which a slash begins a regular expression, in JavaScript.
_BEFORE_REGEX = re.compile(r"(?:^|[(\[{},;=:!&|?+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await))\s*\Z")

#: What may begin something that isn't code, by language; the longer of two that begin alike first.
_MARKS = {
    "javascript": re.compile(r"//|/\*|[\"'`/{}]"),
    "go": re.compile(r"//|/\*|[\"'`]"),
    "java": re.compile(r"//|/\*|\"\"\"|[\"']"),
}
#: The rest of what one of them begins; where it doesn't end, a line's literals end with the line and others with the text.
_RESTS = {
    "//": re.compile(r"[^\n]*"),
    "/*": re.compile(r".*?(?:\*/|\Z)", re.DOTALL),
    '"': re.compile(r"(?:[^\"\\\n]|\\(?:.|\n))*\"?"),
    "'": re.compile(r"(?:[^'\\\n]|\\(?:.|\n))*'?"),
    '"""': re.compile(r"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)", re.DOTALL),
    "raw": re.compile(r"[^`]*`?"),
    "regex": re.compile(r"(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"),
    "template": re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{|\Z)", re.DOTALL),
}


def code_only(source: str, language: str) -> str:
    """`source` with comments, strings, regular expressions and template texts blanked; lengths and lines stay.

    The expressions inside JavaScript's templates are code, also of templates within them.
    """
    out: list[str] = []
    braces: list[int] = []  # open braces of each template expression around the place
    at = kept = 0
    blank = lambda text: re.sub(r"[^\n]", " ", text)

    def skip(begin: int, rest: re.Pattern, end_of_mark: int) -> int:
        nonlocal kept
        stop = rest.match(source, end_of_mark)
        end = stop.end() if stop else end_of_mark
        out.append(source[kept:begin])
        out.append(blank(source[begin:end]))
        kept = end
        return end

    def template(begin: int, inside: int) -> int:
        end = skip(begin, _RESTS["template"], inside)
        if source[max(inside, end - 2) : end] == "${":
            braces.append(0)
        return end

    while found := _MARKS[language].search(source, at):
        mark, begin, at = found[0], found.start(), found.end()
        if mark == "`":
            at = template(begin, at) if language == "javascript" else skip(begin, _RESTS["raw"], at)
        elif mark == "{":
            if braces:
                braces[-1] += 1
        elif mark == "}":
            if braces and braces[-1] == 0:
                braces.pop()
                at = template(begin, at)
            elif braces:
                braces[-1] -= 1
        elif mark == "/":
            before = "".join(out[-2:])[-40:] + source[max(kept, begin - 40) : begin]
            if _BEFORE_REGEX.search(before) and _RESTS["regex"].match(source, at):
                at = skip(begin, _RESTS["regex"], at)
        else:
            at = skip(begin, _RESTS[mark], at)
    out.append(source[kept:])
    return "".join(out)


def pairs(code: str) -> dict[int, int]:
    """Where each opening bracket of `code_only` text is closed; unclosed ones by the text's end."""
    open_at: list[int] = []
    found: dict[int, int] = {}
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            open_at.append(m.start())
        else:
            wanted = "([{"[")]}".index(m[0])]
            for i in range(len(open_at) - 1, -1, -1):
                if code[open_at[i]] == wanted:  # brackets left open inside of it end here, too
                    for lost in open_at[i:]:
                        found[lost] = m.start()
                    del open_at[i:]
                    break
    return found | dict.fromkeys(open_at, len(code) - 1)


def unit_end(code: str, closed: dict[int, int], at: int, block: bool) -> int:
    """The index behind a unit whose head ends at `at`.

    A unit ends with the first block that opens outside of parentheses or, with none, where its statement
    does: at a semicolon, at a bracket that closes something around it, or at a line's end that isn't
    followed by a block. With `block`, lines may pass before the block opens.
    """
    for m in re.compile(r"[(\[{}\])\n;]").finditer(code, at):
        if m.start() < at:
            continue
        if m[0] in "([":
            at = closed[m.start()] + 1
        elif m[0] == "{":
            return closed[m.start()] + 1
        elif m[0] == "\n":
            follows = re.compile(r"\s*(\S?)").match(code, m.end())
            if follows[1] == "{" or (block and follows[1] not in ("", "}", ")", "]")):
                continue
            if not re.search(r"(?:=>|[=+\-*/%&|?:,.<({\[])\s*\Z", code[max(0, m.start() - 60) : m.start()]) and follows[1] not in (".", "?", ":", "+", "&", "|"):
                return m.start()
        else:
            return m.end() if m[0] == ";" else m.start()
    return len(code)
