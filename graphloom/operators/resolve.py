"""Import resolution as ranked candidates joined to the known paths.

Every resolver turns an import into candidate paths with a rank; one equi-join
against the known files and a minimum decide.  ``imports`` has (id, path,
specifier): the importing file and what it names.  The result is (id,
resolved, confidence) with one row an import; ``resolved`` is null where
nothing in the repository matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, directory, normalize, shared_segments

# The probe order of module files.
JS_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
JS_INDEXES = ("/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs")
JS_REWRITABLE = r"\.(js|jsx|mjs|cjs)$"


def _first_known(ranked: DataFrame, imports: DataFrame, known: DataFrame) -> DataFrame:
    """``ranked``: (id, rank, candidate).  The known candidate of least rank resolves the import."""
    hits = ranked.join(known.select(F.col("path").alias("candidate")), "candidate", "left_semi")
    best = hits.groupBy("id").agg(F.min_by("candidate", "rank").alias("resolved"))
    tier = F.when(F.col("resolved").isNull(), F.lit("unresolved")).otherwise(F.lit("resolved"))
    return imports.select("id").join(best, "id", "left").select("id", "resolved", tier.alias("confidence"))


def _explode(imports: DataFrame, candidates: Column) -> DataFrame:
    return imports.select("id", F.posexplode(candidates).alias("rank", "candidate")).where(F.col("candidate").isNotNull())


def javascript(imports: DataFrame, known: DataFrame) -> DataFrame:
    """Relative specifiers only; a ``.js`` name may stand for its TypeScript source."""
    spec = F.col("specifier")
    joined = F.concat_ws("/", directory("path"), spec)
    # A trailing slash stays on the base, so that only the base itself could match.
    base = F.concat(normalize(joined), F.when(F.endswith(spec, F.lit("/")), F.lit("/")).otherwise(F.lit("")))
    base = F.when(base == "", F.lit(".")).otherwise(base)
    stem = F.regexp_replace(base, JS_REWRITABLE, "")
    rewritten = F.array(*(F.concat(stem, F.lit(e)) for e in JS_EXTENSIONS))
    plain = F.array(base, *(F.concat(base, F.lit(e)) for e in JS_EXTENSIONS + JS_INDEXES))
    probes = F.when(base.rlike(JS_REWRITABLE), F.concat(rewritten, plain)).otherwise(plain)
    relative = imports.where(F.startswith(spec, F.lit(".")))
    return _first_known(_explode(relative, probes), imports, known)


def python(imports: DataFrame, known: DataFrame) -> DataFrame:
    """Dotted names from the root, leading dots from the importing package; the last
    segment may be a name inside the module rather than a module."""
    spec = F.col("specifier")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.regexp_replace(spec, r"^\.+", "")
    segments = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, r"\."))
    here = F.when(directory("path") == "", F.array().cast("array<string>")).otherwise(F.split(directory("path"), "/"))
    climbs = dots - 1
    base = F.when(dots == 0, F.array().cast("array<string>")).when(climbs <= F.size(here), F.slice(here, F.lit(1), F.size(here) - climbs))
    full = F.concat(base, segments)
    shorter = F.when(F.size(segments) > 1, F.concat(base, F.slice(segments, F.lit(1), F.size(segments) - 1)))
    join = lambda a: F.array_join(a, "/")
    with_end = lambda a, end: F.when(F.size(a) > 0, F.concat(join(a), F.lit(end)))
    probes = F.array(*(with_end(a, end) for a in (full, shorter) for end in (".py", "/__init__.py")))
    return _first_known(_explode(imports.where(base.isNotNull()), probes), imports, known)


def go(imports: DataFrame, known: DataFrame, prefix: str | None) -> DataFrame:
    """Packages under the module's own prefix; the first file of the directory stands for it."""
    if prefix is None:
        return imports.select("id", F.lit(None).cast("string").alias("resolved"), F.lit("unresolved").alias("confidence"))
    spec = F.col("specifier")
    own = imports.where((spec == prefix) | F.startswith(spec, F.lit(prefix + "/")))
    target = own.select("id", F.when(spec == prefix, F.lit("")).otherwise(F.substring(spec, len(prefix) + 2, 1 << 20)).alias("dir"))
    packages = known.where(F.endswith("path", F.lit(".go"))).groupBy(directory("path").alias("dir")).agg(F.min("path").alias("resolved"))
    found = target.join(packages, "dir").select("id", "resolved")
    tier = F.when(F.col("resolved").isNull(), F.lit("unresolved")).otherwise(F.lit("resolved"))
    return imports.select("id").join(found, "id", "left").select("id", "resolved", tier.alias("confidence"))


def java(imports: DataFrame, known: DataFrame) -> DataFrame:
    """Fully qualified names below any source root; the root that shares most of the
    importer's path wins, and a tie is ambiguous."""
    spec = F.col("specifier")
    named = imports.where(~F.endswith(spec, F.lit(".*"))).select("id", "path", F.concat(F.translate(spec, ".", "/"), F.lit(".java")).alias("suffix"))
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    files = known.where(F.endswith("path", F.lit(".java"))).select(F.col("path").alias("candidate"), F.explode(suffixes).alias("suffix"))
    scored = named.join(files, "suffix").select("id", "candidate", shared_segments("path", "candidate").alias("score"))
    top = scored.groupBy("id", "score").agg(F.min("candidate").alias("resolved"), F.count(F.lit(1)).alias("n"))
    best = top.groupBy("id").agg(F.max_by(F.struct("resolved", "n"), "score").alias("b")).select("id", "b.resolved", "b.n")
    tier = F.when(F.col("n").isNull(), F.lit("unresolved")).when(F.col("n") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous"))
    return imports.select("id").join(best, "id", "left").select("id", "resolved", tier.alias("confidence"))


def rust(imports: DataFrame, known: DataFrame) -> DataFrame:
    """``crate``, ``self`` and ``super`` paths; a module that is both ``x.rs`` and
    ``x/mod.rs`` is ambiguous."""
    roots = known.where(F.col("path").rlike(r"(^|/)(main|lib)\.rs$")).select(directory("path").alias("dir")).distinct()
    above = imports.select("path").distinct().select("path", F.posexplode(ancestors("path")).alias("rank", "dir"))
    crate = above.join(roots, "dir", "left_semi").groupBy("path").agg(F.min_by("dir", "rank").alias("crate"))
    rows = imports.join(crate, "path", "left").withColumn("crate", F.coalesce("crate", F.lit("src")))
    glob = F.endswith("specifier", F.lit("::*"))
    segments = F.filter(F.split(F.regexp_replace("specifier", r"::\*$", ""), "::"), lambda x: x != "")
    head = F.get(segments, F.lit(0))
    name = F.regexp_extract("path", r"([^/]*)\.rs$", 1)
    own = F.when(name.isin("mod", "main", "lib"), directory("path")).otherwise(F.regexp_replace("path", r"\.rs$", ""))
    base = F.when(head == "crate", F.col("crate")).when(head == "self", own).when(head == "super", directory(own))
    rest = F.slice(segments, F.lit(2), F.size(segments))
    lists = F.when(glob | (F.size(rest) == 0), F.array(rest)).otherwise(F.array(rest, F.slice(rest, F.lit(1), F.size(rest) - 1)))
    tried = rows.select("id", "crate", base.alias("base"), F.posexplode(lists).alias("rank", "mods")).where(F.col("base").isNotNull())
    join = F.when(F.size("mods") == 0, F.col("base")).when(F.col("base") == "", F.array_join("mods", "/")).otherwise(F.concat_ws("/", "base", F.array_join("mods", "/")))
    tried = tried.withColumn("module", join).join(roots.select(F.col("dir").alias("base"), F.lit(True).alias("is_root")), "base", "left")
    at_root = (F.size("mods") == 0) & F.coalesce("is_root", F.lit(False))
    below = lambda f: F.when(F.col("module") == "", F.lit(f)).otherwise(F.concat_ws("/", "module", F.lit(f)))
    named = F.when(F.col("module") != "", F.array(F.concat(F.col("module"), F.lit(".rs")), below("mod.rs")))
    files = F.when(at_root, F.array(below("lib.rs"), below("main.rs"))).otherwise(named)
    each = tried.select("id", "rank", at_root.alias("at_root"), F.posexplode(files).alias("pos", "candidate"))
    hits = each.join(known.select(F.col("path").alias("candidate")), "candidate", "left_semi")
    ranked = hits.groupBy("id", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("at_root").alias("at_root"), F.min("candidate").alias("least"), F.min_by("candidate", "pos").alias("first")
    )
    best = ranked.groupBy("id").agg(F.min_by(F.struct("n", "at_root", "least", "first"), "rank").alias("b")).select("id", "b.*")
    resolved = F.when(F.col("at_root"), F.col("first")).otherwise(F.col("least"))
    tier = F.when(F.col("n").isNull(), F.lit("unresolved")).when(F.col("at_root") | (F.col("n") == 1), F.lit("resolved")).otherwise(F.lit("ambiguous"))
    return imports.select("id").join(best, "id", "left").select("id", resolved.alias("resolved"), tier.alias("confidence"))


def resolve_imports(imports: DataFrame, known: DataFrame, go_prefix: str | None = None) -> DataFrame:
    """Each import by the rules of its file's language; unknown languages follow JavaScript's.

    ``imports`` has (id, path, lang, specifier).
    """
    part = lambda *langs: imports.where(F.col("lang").isin(*langs))
    out = python(part("python"), known).unionByName(go(part("go"), known, go_prefix)).unionByName(java(part("java"), known)).unionByName(rust(part("rust"), known))
    rest = imports.where(~F.coalesce(F.col("lang").isin("python", "go", "java", "rust"), F.lit(False)))
    return out.unionByName(javascript(rest, known))
