"""The extraction step: one row a file, whatever its language or state."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import EXTENSIONS, language_of
from ..schemas import PARSED_FILE, PARSED_LISTS
from . import braces, python_source

EMPTY: dict = {"symbols": [], "imports": [], "call_sites": [], "errors": []}


def language(path: str) -> str | None:
    base = path.rsplit("/", 1)[-1]
    dot = base.rfind(".")
    return EXTENSIONS.get(base[dot:]) if dot > 0 else None


def loc(source: str) -> int:
    return 0 if source == "" else source.count("\n") + 1 - source.endswith("\n")


def parse(path: str, source: str) -> dict:
    """A file's record; unknown languages have one too, with empty lists."""
    lang = language(path)
    found = EMPTY if lang is None else python_source.extract(source) if lang == "python" else braces.extract(source, lang)
    return {"path": path, "lang": lang, "content_hash": hashlib.sha256(source.encode()).hexdigest(), "loc": loc(source), **found}


def parse_safely(path: str, source: str) -> dict:
    """Like ``parse``; a failure becomes an error row without a hash, so that it is tried again."""
    try:
        return parse(path, source)
    except Exception as e:  # noqa: BLE001  any fault of a file must not end the run
        return {"path": path, "lang": language(path), "content_hash": "", "loc": 0, **EMPTY, "errors": [{"line": 1, "message": str(e)[:200]}]}


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` has (path, content BINARY); the result has the parsed-file schema.

    Files of unknown languages never reach Python.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.select("path", text.alias("source"), language_of("path").alias("lang"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([parse_safely(p, s) for p, s in zip(pdf["path"], pdf["source"], strict=True)], columns=["path", "lang", "content_hash", "loc", *PARSED_LISTS])

    from ..functions.scores import lines_of_code

    known = rows.where("lang is not null").select("path", "source").mapInPandas(run, PARSED_FILE)
    rest = rows.where("lang is null")
    empty = [F.array().cast(kind).alias(c) for c, kind in PARSED_LISTS.items()]
    return known.unionByName(rest.select("path", F.col("lang").cast("string").alias("lang"), F.sha2("source", 256).alias("content_hash"), lines_of_code("source").alias("loc"), *empty))
