"""Extraction from brace languages: patterns over masked source.

Declarations are found by pattern, their extent by bracket matching; parents
and enclosing functions follow from nesting of extents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .masking import Lines, mask, pairs

_COMMON = "if for while switch return else do".split()
_C_WORDS = frozenset([*_COMMON, *"catch function super this typeof new async await throw assert synchronized".split()])
_GO_WORDS = frozenset([*_COMMON, *"func go defer select range".split()])
_RUST_WORDS = frozenset([*_COMMON, *"fn loop match in as move unsafe".split()])


@dataclass(frozen=True)
class Language:
    declarations: tuple[tuple[str, str], ...]  # (kind, pattern with group name)
    containers: tuple[str, ...]  # kinds that own members
    words: frozenset[str] = _C_WORDS  # names that are not names
    call: str = r"(?<![\w$])(?P<new>new\s+)?(?:[\w$]+\s*(?:\.|::|\?\.)\s*)*(?P<name>[A-Za-z_$][\w$]*)\s*\("


_JS = Language(
    declarations=(
        ("class", r"(?<![\w$.])(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)"),
        ("interface", r"(?<![\w$.])interface\s+(?P<name>[A-Za-z_$][\w$]*)"),
        ("enum", r"(?<![\w$.])enum\s+(?P<name>[A-Za-z_$][\w$]*)"),
        ("type", r"(?<![\w$.])type\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="),
        ("function", r"(?<![\w$.])(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"),
        ("function", r"(?<![\w$.])(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|[A-Za-z_$][\w$]*\s*=>)"),
        ("method", r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*\*?(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^()]*>)?\([^{};]*\)\s*(?::[^{};=]+)?\{"),
    ),
    containers=("class",),
)
_GO = Language(
    declarations=(
        ("method", r"(?m)^func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)"),
        ("function", r"(?m)^func\s+(?P<name>\w+)"),
        ("type", r"(?m)^[ \t]*type\s+(?P<name>\w+)(?=[\s\[])(?!\s*=)"),  # not an alias
    ),
    containers=(),
    words=_GO_WORDS,
)
_JAVA = Language(
    declarations=(
        ("class", r"(?<![\w.])(?:class|record)\s+(?P<name>\w+)"),
        ("interface", r"(?<![\w.])@?interface\s+(?P<name>\w+)"),
        ("enum", r"(?<![\w.])enum\s+(?P<name>\w+)"),
        ("method", r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^()]*>\s*)?[\w.<>\[\],?]+(?:\s*<[^(){};]*>)?(?:\[\])*\s+(?P<name>\w+)\s*\([^(){};]*\)\s*(?:throws\s+[\w.,\s]+)?[{;]"),
    ),
    containers=("class", "interface", "enum"),
)
_RUST = Language(
    declarations=(
        ("class", r"(?<!\w)struct\s+(?P<name>\w+)"),
        ("enum", r"(?<!\w)enum\s+(?P<name>\w+)"),
        ("interface", r"(?<!\w)trait\s+(?P<name>\w+)"),
        ("type", r"(?<!\w)type\s+(?P<name>\w+)"),
        ("function", r"(?<!\w)fn\s+(?P<name>\w+)"),
        ("impl", r"(?<!\w)impl(?:\s*<[^{;]*?>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{;]*?>)?\s+for\s+)?(?P<name>[\w:]+)"),
    ),
    containers=("impl", "interface"),
    words=_RUST_WORDS,
    call=r"(?<![\w!])(?P<new>)(?:\w+\s*(?:\.|::)\s*)*(?P<name>[A-Za-z_]\w*)\s*(?:::<[^()]*>)?\(",
)
LANGUAGES = {"typescript": _JS, "tsx": _JS, "javascript": _JS, "jsx": _JS, "go": _GO, "java": _JAVA, "rust": _RUST}


def _body(masked: str, at: int, match: dict[int, int], by_line: bool = False) -> tuple[int, int]:
    """(start of the body, end of the declaration) from the end of its name; by_line: a line's end ends it too."""
    depth = 0
    for m in re.finditer(r"[(){};\n\[\]]", masked[at:]):
        c, pos = m.group(), at + m.start()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c == "{":
            return pos, match.get(pos, len(masked) - 1)
        elif depth <= 0 and (c in ";}" or by_line and c == "\n"):
            return pos, pos
    return len(masked), len(masked) - 1


def _type_groups(masked: str, match: dict[int, int]):
    """(start, end, name start, name) of each type in a ``type ( ... )`` group; they share the group's extent."""
    member = re.compile(r"(?m)[(\[{]|^[ \t]*(?P<name>\w+)(?=[ \t\[])(?![ \t]*=)")
    for group in re.finditer(r"(?m)^[ \t]*(?P<type>type)\s*\(", masked):
        opening = group.end() - 1
        end, at = match.get(opening, len(masked) - 1), opening + 1
        while (m := member.search(masked, at, end)) is not None:
            if m.group("name") is None:
                at = match.get(m.start(), end) + 1  # what lies in brackets is no member
            else:
                yield group.start("type"), end, m.start("name"), m.group("name")
                at = m.end()


def _imports(source: str, masked: str, lang: str, lines: Lines) -> list[dict]:
    found = []

    def add(kind, spec, at):
        found.append((at, {"specifier": spec, "kind": kind, "line": lines.of(at)}))

    if lang == "go":
        for m in re.finditer(r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", source):
            add("static", m.group(1), m.start(1))
        for block in re.finditer(r"(?ms)^import\s*\((.*?)\)", source):
            for m in re.finditer(r"(?m)^\s*(?:[\w.]+\s+)?\"([^\"]+)\"", block.group(1)):
                add("static", m.group(1), block.start(1) + m.start(1))
    elif lang == "java":
        for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", masked):
            add("static", m.group(1), m.start(1))
    elif lang == "rust":
        for m in re.finditer(r"(?<!\w)use\s+((?:\w+\s*::\s*)+(?:\w+|\*))\s*(?:as\s+\w+\s*)?;", masked):
            add("static", re.sub(r"\s", "", m.group(1)), m.start(1))
    else:
        for m in re.finditer(r"(?m)(?:^|[;}\s])(?:import|export)\b[^;'\"()]*?(?:from\s*)?['\"]([^'\"\n]+)['\"]", source):
            if masked[m.start(1) - 1] == " " and masked[m.start() : m.start(1) - 1].strip().startswith(("import", "export")):
                add("static", m.group(1), m.start(1))
        for kind, pattern in (("dynamic", r"(?<![\w$.])import\s*\(\s*['\"]([^'\"\n]+)['\"]"), ("require", r"(?<![\w$.])require\s*\(\s*['\"]([^'\"\n]+)['\"]")):
            for m in re.finditer(pattern, source):
                if masked[m.start()] != " ":
                    add(kind, m.group(1), m.start(1))
    return [x for _, x in sorted(found, key=lambda y: y[0])]


def _exported(lang: str, source: str, masked: str, start: int, kind: str, name: str, owner) -> bool:
    head = masked[masked.rfind("\n", 0, start) + 1 : start]
    if lang == "go":
        return name[:1].isupper()
    if lang == "java":
        text = head + masked[start : masked.find(name, start)]
        return bool(re.search(r"(?<!\w)public(?!\w)", text)) or (kind != "class" and owner is not None and owner[0] == "interface")
    if lang == "rust":
        if owner is not None and (owner[0] == "interface" or owner[2]):
            return True
        return bool(re.search(r"(?<!\w)pub(?:\s*\([^)]*\))?\s*(?:async\s+|const\s+|unsafe\s+|extern\s+)*$", head))
    if owner is not None:
        return owner[3]
    return bool(re.search(r"(?<![\w$])export\s+(?:default\s+|declare\s+)*(?:abstract\s+|async\s+)*$", head)) or head.strip().startswith("export")


def extract(source: str, lang: str) -> dict:
    spec, masked = LANGUAGES[lang], mask(source, lang)
    lines, (match, wrong) = Lines(source), pairs(masked)
    raw = []
    taken: set[int] = set()
    for kind, pattern in spec.declarations:
        for m in re.finditer(pattern, masked):
            name = m.group("name")
            if m.start("name") in taken or name in spec.words or (kind == "method" and lang == "java" and re.match(r"\s*(?:return|new|else|throw)\b", m.group())):
                continue
            taken.add(m.start("name"))
            body, end = _body(masked, m.end("name"), match, lang == "go" and kind == "type")
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            groups = m.groupdict()
            raw.append((start, body, end, kind, name, groups.get("owner"), groups.get("trait"), m.start("name"), False))
    if lang == "go":
        raw += [(start, _body(masked, at + len(name), match, True)[0], end, "type", name, None, None, at, True) for start, end, at, name in _type_groups(masked, match)]
    raw.sort(key=lambda r: (r[0], -r[2]))
    symbols, functions, stack = [], [], []
    bare = [(start, end) for start, _, end, kind, *_ in raw if kind == "interface" and lang != "rust"]  # member lists, not calls
    for start, body, end, kind, name, owner_name, trait, at, grouped in raw:
        while stack and stack[-1][1] < start:
            stack.pop()
        owner = stack[-1][2] if stack else None
        inside_function = any(x[2][0] in ("function", "method") for x in stack)
        if kind == "method" and lang in ("typescript", "tsx", "javascript", "jsx") and (owner is None or owner[0] != "class"):
            continue
        out_kind = "method" if kind == "function" and owner is not None and owner[0] in spec.containers and lang == "rust" else kind
        exported = False if kind == "impl" else _exported(lang, source, masked, start, kind, name, owner if owner and owner[0] in spec.containers else None)
        entry = (out_kind, name.split("::")[-1], bool(trait), exported)
        stack.append((start, end, entry))
        if kind == "impl":
            continue
        parent = owner_name or (owner[1] if owner is not None and owner[0] in ("class", "interface", "impl", "enum") else None)
        symbols.append({"name": name, "kind": out_kind, "start_line": lines.of(start), "end_line": lines.of(end), "exported": exported and not (inside_function and lang not in ("go",)), "signature": source[at if grouped else start : body].strip()[:300] or None, "parent_name": parent})
        if out_kind in ("function", "method"):
            functions.append((start, end, name, at))
    names_at = {f[3] for f in functions}
    calls = []
    for m in re.finditer(spec.call, masked):
        name = m.group("name")
        if name in spec.words or name in ("require", "import") or m.start("name") in names_at or (lang == "rust" and masked[m.start("name") - 1 : m.start("name")] == "!"):
            continue
        if re.search(r"(?<!\w)(?:func|fn|function)\s*$", masked[max(0, m.start("name") - 12) : m.start("name")]):
            continue
        at = m.start("name")
        inner = [f for f in functions if f[0] <= at <= f[1]]
        if any(a <= at <= b for a, b in bare) and not inner:
            continue
        calls.append({"name": name, "line": lines.of(at), "enclosing_symbol": max(inner)[2] if inner else None, "kind": "instantiates" if m.group("new") else "calls"})
    errors = [{"line": lines.of(at), "message": "unbalanced bracket"} for at in sorted(wrong)]
    return {"symbols": symbols, "imports": _imports(source, masked, lang, lines), "call_sites": calls, "errors": errors}
