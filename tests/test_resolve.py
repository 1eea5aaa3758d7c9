"""Import resolvers over literal sets of known paths."""

import pytest

from graphloom.operators import resolve


def run(spark, resolver, path, specifier, known, *more):
    imports = spark.createDataFrame([(1, path, specifier)], "id bigint, path string, specifier string")
    row = resolver(imports, spark.createDataFrame([(k,) for k in known], "path string"), *more).first()
    return row["resolved"], row["confidence"]


UNRESOLVED = (None, "unresolved")


@pytest.mark.parametrize(
    "specifier,known,want",
    [
        ("./b", ["src/b.ts", "src/b/index.ts"], "src/b.ts"),
        ("./b.js", ["src/b.ts", "src/b.js"], "src/b.ts"),
        ("./b.js", ["src/b.js"], "src/b.js"),
        ("../lib", ["lib/index.tsx"], "lib/index.tsx"),
        ("../../out", ["out.ts"], None),
        ("lodash", ["src/lodash.ts"], None),
        ("./x/", ["src/x/index.ts"], None),
        ("./b.json", ["src/b.json"], "src/b.json"),
    ],
)
def test_javascript(spark, specifier, known, want):
    assert run(spark, resolve.javascript, "src/a.ts", specifier, known) == ((want, "resolved") if want else UNRESOLVED)


@pytest.mark.parametrize(
    "specifier,known,want",
    [
        ("pkg.service", ["pkg/service.py", "pkg/__init__.py"], "pkg/service.py"),
        ("pkg.service.Service", ["pkg/service.py"], "pkg/service.py"),
        ("pkg.helper", ["pkg/__init__.py"], "pkg/__init__.py"),
        (".helper.f", ["pkg/helper.py"], "pkg/helper.py"),
        ("..top", ["top.py"], "top.py"),
        ("...far", ["far.py"], None),
        ("os", ["__init__.py"], None),
        (".", ["pkg/__init__.py"], "pkg/__init__.py"),
    ],
)
def test_python(spark, specifier, known, want):
    assert run(spark, resolve.python, "pkg/a.py", specifier, known) == ((want, "resolved") if want else UNRESOLVED)


@pytest.mark.parametrize("specifier,want", [("example.com/m/helper", "helper/a.go"), ("example.com/m", "main.go"), ("example.com/mother", None), ("fmt", None)])
def test_go(spark, specifier, want):
    known = ["helper/b.go", "helper/a.go", "main.go", "other/x.go"]
    assert run(spark, resolve.go, "main.go", specifier, known, "example.com/m") == ((want, "resolved") if want else UNRESOLVED)
    assert run(spark, resolve.go, "main.go", specifier, known, None) == UNRESOLVED


@pytest.mark.parametrize(
    "specifier,known,want",
    [
        ("com.x.A", ["m1/src/com/x/A.java", "m2/src/com/x/A.java"], ("m1/src/com/x/A.java", "resolved")),
        ("com.x.A", ["m2/src/com/x/A.java", "m3/src/com/x/A.java"], ("m2/src/com/x/A.java", "ambiguous")),
        ("com.x.*", ["m1/src/com/x/A.java"], UNRESOLVED),
        ("java.util.List", ["m1/src/com/x/A.java"], UNRESOLVED),
    ],
)
def test_java(spark, specifier, known, want):
    assert run(spark, resolve.java, "m1/src/com/x/B.java", specifier, known) == want


@pytest.mark.parametrize(
    "path,specifier,known,want",
    [
        ("src/main.rs", "crate::helper::help", ["src/main.rs", "src/helper.rs"], ("src/helper.rs", "resolved")),
        ("src/util/mod.rs", "super::helper", ["src/main.rs", "src/helper.rs"], ("src/helper.rs", "resolved")),
        ("src/a.rs", "self::b", ["src/main.rs", "src/a/b.rs"], ("src/a/b.rs", "resolved")),
        ("src/a.rs", "crate::x", ["src/lib.rs", "src/x.rs", "src/x/mod.rs"], ("src/x.rs", "ambiguous")),
        ("src/a.rs", "crate::Thing", ["src/lib.rs", "src/main.rs"], ("src/lib.rs", "resolved")),
        ("src/a.rs", "std::io", ["src/lib.rs"], UNRESOLVED),
        ("src/a.rs", "crate::x::*", ["src/lib.rs", "src/x/mod.rs"], ("src/x/mod.rs", "resolved")),
        ("src/a.rs", "crate::y::*", ["src/lib.rs"], UNRESOLVED),
        ("w/core/src/a.rs", "crate::b", ["w/core/src/lib.rs", "w/core/src/b.rs", "src/b.rs"], ("w/core/src/b.rs", "resolved")),
    ],
)
def test_rust(spark, path, specifier, known, want):
    assert run(spark, resolve.rust, path, specifier, known) == want
