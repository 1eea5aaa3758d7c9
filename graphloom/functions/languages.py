"""The language registry: extensions, entry points and classification columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, extension

# File extensions by language.
EXTENSIONS = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx",
    ".py": "python", ".go": "go", ".java": "java", ".rs": "rust",
}
# Directories never indexed.
VENDORED = ("node_modules", "vendor", "dist", "build", ".venv", "venv", ".git", "target")
MAX_BYTES = 1_000_000
SNIFF_BYTES = 8000
MAX_LINE_AVERAGE = 500


def language_of(path) -> Column:
    """The language of a path by its extension (case counts); null where unknown."""
    e = extension(path)
    out = F.lit(None).cast("string")
    for ext, lang in EXTENSIONS.items():
        out = F.when(e == ext, F.lit(lang)).otherwise(out)
    return out


def vendored(path) -> Column:
    """Whether a directory that is never indexed lies on the path."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(v) for v in VENDORED)))


def skip_reason(path, size, content, readable=None, is_file=None) -> Column:
    """Why a candidate is not indexed, the first reason that holds; null where it is."""
    p, n, raw = (F.col(x) if isinstance(x, str) else x for x in (path, size, content))
    text = F.make_valid_utf8(raw.cast("string"))
    known = language_of(p).isNotNull()
    lines = F.greatest(F.size(F.split(text, "\n")), F.lit(1))
    minified = basename(p).rlike(r"\.min\.[a-z]+$") | (F.length(text) / lines > MAX_LINE_AVERAGE)
    binary = F.contains(F.substring(raw, 1, SNIFF_BYTES), F.lit(b"\x00"))
    return (
        F.when(vendored(p), F.lit("vendored"))
        .when(~(readable if readable is not None else F.lit(True)), F.lit("unreadable"))
        .when(~(is_file if is_file is not None else F.lit(True)), F.lit("not-a-file"))
        .when(n > MAX_BYTES, F.lit("too-large"))
        .when(known & F.coalesce(minified, F.lit(False)), F.lit("minified"))
        .when(~known & F.coalesce(binary, F.lit(False)), F.lit("binary"))
    )
