"""Blanks out comments and strings, and pairs brackets, keeping every offset."""

from __future__ import annotations

import re
from bisect import bisect_right

_C_LIKE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
#: A Rust lifetime is not a character literal.
_RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?(?:\"\1|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^\n]+?|[^'\\\n])'", re.S)


def mask(source: str, lang: str) -> str:
    """The source with comment and string contents as spaces, line ends kept."""
    blank = lambda m: "".join(c if c == "\n" else " " for c in m.group())
    return (_RUST if lang == "rust" else _C_LIKE).sub(blank, source)


class Lines:
    """Offsets to 1-based line numbers."""

    def __init__(self, source: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def pairs(masked: str) -> tuple[dict[int, int], list[int]]:
    """(matching close of every open brace, offsets of unmatched brackets)."""
    want, stack, match, wrong = {")": "(", "]": "[", "}": "{"}, [], {}, []
    for m in re.finditer(r"[()\[\]{}]", masked):
        c, at = m.group(), m.start()
        if c in "([{":
            stack.append((c, at))
        elif stack and stack[-1][0] == want[c]:
            match[stack.pop()[1]] = at
        else:
            wrong.append(at)
    return match, wrong + [at for _, at in stack]
