"""The exact operators against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import components, near_copies, repeats, simhash, substring_dedup, suffix_dedup
from graphloom.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def brute_words(texts, width):
    count, of = {}, {i: WORD.findall(t) for i, t in texts.items()}
    for w in of.values():
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            count[key] = count.get(key, 0) + 1
    out = {}
    for i, w in of.items():
        hit = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                hit[k : k + width] = [True] * width
        kept = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
        out[i] = (len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(texts, width):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        hit = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if b[k : k + width] in seen:
                hit[k : k + width] = b"\1" * width
            seen.add(b[k : k + width])
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out[i] = (len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    return out


def brute_fingerprint(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    sh = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


#: Bytes of a group that a task takes: production, and so few that prefixes grow up to whole windows.
HOT = [repeats.KEY_BYTES, 300]


@pytest.fixture(scope="module")
def boilerplate(spark, corpus):
    """The corpus and texts that share short phrases in ever new surroundings, so that groups outgrow a small task."""
    rng = random.Random(6)
    phrase = [f"common{i}" for i in range(14)]
    half = [f"tail{i}" for i in range(40)]
    rows = [(100 + i, f"a{i} " + " ".join(phrase + half[: 22 + i % 5]) + f"  b{rng.randrange(9)}\n" + " ".join(f"x{rng.randrange(3)}" for _ in range(60)), "en", "s", 0) for i in range(40)]
    return corpus.unionByName(spark.createDataFrame(rows, corpus.schema))


@pytest.mark.parametrize("hot", HOT)
def test_substring_dedup_matches_brute_force(spark, boilerplate, tables, monkeypatch, hot):
    monkeypatch.setattr(repeats, "KEY_BYTES", hot)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in Q.op8_substring_dedup(spark, tables(documents=boilerplate)).collect()}
    assert got == brute_words(texts_of(boilerplate), 35)


@pytest.mark.parametrize("hot", HOT)
def test_suffix_dedup_matches_brute_force(spark, boilerplate, tables, monkeypatch, hot):
    monkeypatch.setattr(repeats, "KEY_BYTES", hot)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in Q.op6_suffix_array_dedup(spark, tables(documents=boilerplate)).collect()}
    assert got == brute_bytes(texts_of(boilerplate), 100)


def test_small_batches_and_buckets_change_nothing(corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 400)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 400)
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(corpus).collect()}
    assert got == brute_words(texts_of(corpus), 35)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(corpus).collect()}
    assert got == brute_bytes(texts_of(corpus), 100)


def test_other_widths(corpus):
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(corpus, min_words=12).collect()}
    assert got == brute_words(texts_of(corpus), 12)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(corpus, min_bytes=17).collect()}
    assert got == brute_bytes(texts_of(corpus), 17)


def test_rows_that_share_an_id(spark):
    """Equal rows, one id with two texts, no id at all, and names that clash with the operators' own."""
    rng = random.Random(1)
    t, u, v = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "tuv")
    rows = [(1, t), (1, t), (1, u), (2, t), (None, v), (None, v), (None, u + " tail"), (3, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id bigint, text string, id int, row int, key string")
    cut = sorted((r["id"] if r["id"] is not None else 9, r["n_words"], r["n_removed"]) for r in substring_dedup.digest(docs).collect())
    assert cut == [(1, 60, 60), (1, 60, 60), (1, 60, 60), (2, 60, 60), (3, 0, 0), (9, 60, 60), (9, 60, 60), (9, 61, 60)]
    cut = sorted((r["id"] if r["id"] is not None else 9, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(docs).collect())
    nt, nu, nv = len(t), len(u), len(v)
    assert cut == sorted([(1, nt, 0), (1, nt, 0), (1, nu, 0), (2, nt, nt), (3, 0, 0), (9, nv, 0), (9, nv, 0), (9, nu + 5, nu)])
    left = substring_dedup.digest(spark.createDataFrame([(1, t), (1, u), (2, t)], "doc_id bigint, text string")).collect()
    assert sorted((r["id"], r["n_removed"]) for r in left) == [(1, 0), (1, 60), (2, 60)]
    kept = substring_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == {(None, "tail"), (3, None)}


def test_very_long_words_and_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "KEY_BYTES", 5000)
    words = [f"{i:03d}" + "y" * 3000 for i in range(45)]
    long = " ".join(f"n{i}" for i in range(40_000))
    texts = {1: " ".join(words), 2: "a " + "  ".join(words[3:]), 3: "b " + "\n".join(words[5:]), 4: long, 5: "lead " + long[100:]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(docs).collect()}
    assert got == brute_words(texts, 35)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(docs).collect()}
    assert got == brute_bytes(texts, 100)


def test_text_ids(spark):
    p = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([("b", p), ("a", p), (None, p)], "doc_id string, text string")
    assert {r["id"]: r["n_removed"] for r in suffix_dedup.digest(docs).collect()} == {"a": 0, "b": len(p), None: len(p)}
    assert {r["id"]: r["n_removed"] for r in substring_dedup.digest(docs).collect()} == {"a": 40, "b": 40, None: 40}


def test_index_family_is_of_sorted_arrays_that_merge_geometrically():
    import numpy as np

    family, rng, seen = suffix_dedup.IndexFamily(), np.random.default_rng(0), set()
    for _ in range(40):
        buf = rng.integers(97, 99, 80).astype(np.uint8)
        heads = suffix_dedup.heads_of(buf, np.arange(64), 16)
        want = []
        for k in heads.tolist():
            want.append(k in seen)
            seen.add(k)
        assert family.add(heads).tolist() == want
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    for level in family.levels:
        assert level.heads.tolist() == sorted(set(level.heads.tolist())) and len(set(level.places.tolist())) == len(level)


def test_a_stored_family_takes_batches(spark, corpus, tmp_path):
    """Batches in the order of their ids give what one batch gives; the family is opened anew for each."""
    home, got, sizes = f"file://{tmp_path}/family", {}, []
    for a, b in ((0, 10), (10, 14), (14, 30), (30, 45), (45, 45), (45, 60)):
        family = suffix_dedup.StoredFamily(spark, home)
        found = suffix_dedup.digest(corpus.where(F.col("doc_id").between(a, b - 1)), family=family)
        got |= {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()}
        sizes = [n for _, n in suffix_dedup.StoredFamily(spark, home).levels]
        assert all(x > 2 * y for x, y in zip(sizes, sizes[1:], strict=False))
    assert got == brute_bytes(texts_of(corpus), 100)
    assert len(list((tmp_path / "family").glob("level-*"))) == len(sizes)
    with pytest.raises(ValueError):
        suffix_dedup.StoredFamily(spark, home, min_bytes=50)


def test_zero_bytes_are_told_apart():
    import numpy as np

    buf = np.frombuffer(b"ab\0\0ab\0\0\0b", np.uint8)
    assert suffix_dedup.IndexFamily().add(suffix_dedup.heads_of(buf, np.arange(8), 3)).tolist() == [False, False, False, False, True, True, False, False]


def test_suffix_trees_number_their_nodes():
    import numpy as np

    tree = substring_dedup.SuffixTree(np.array([[1, 2, 3], [1, 2, 4], [0, 2, 3], [1, 2, 3]]))
    assert len(set(tree.nodes(2).tolist())) == 2 and tree.nodes(3)[0] == tree.nodes(3)[3] != tree.nodes(3)[1]


def test_drop_repeats_keeps_columns_and_spacing(spark):
    p = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"head  one {p} tail", "a"), (2, p, "b"), (3, "", "c"), (4, None, "d"), (5, "clean text", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ranges string")
    got = {r["doc_id"]: (r["text"], r["ranges"]) for r in substring_dedup.drop_repeats(docs).collect()}
    assert got == {1: ("head  one tail", "a"), 3: ("", "c"), 4: (None, "d"), 5: ("clean text", "e")}


def test_simhash_matches_brute_force(spark, corpus, tables):
    texts = texts_of(corpus)
    fp = {i: brute_fingerprint(t, 4) for i, t in texts.items()}
    parent = {i: i for i in fp}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op2_simhash_near_dedup(spark, tables(documents=corpus)).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def test_fingerprint_links_connect_random_clusters(spark):
    import random

    rng = random.Random(9)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << b
            prints.add(x - (1 << 64) if x >= 1 << 63 else x)
    prints = sorted(prints)
    first, second, third = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), 4)
    got = {r["node"]: r["component"] for r in components.connected_components(first.unionByName(second).unionByName(third)).collect()}
    label = {p: p for p in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 4 and label[b] < label[a]:
                    label[a], moved = label[b], True
    linked = {p for p in prints if any(q != p and bin((p ^ q) & (2**64 - 1)).count("1") <= 4 for q in prints)}
    assert got == {p: label[p] for p in linked}


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_components_in_one_task_and_by_rounds(spark, kind):
    rng = random.Random(4)
    name = (lambda x: f"é{x}") if kind == "string" else (lambda x: x - 150)
    pairs = [(name(rng.randrange(300)), name(rng.randrange(300))) for _ in range(200)]
    want = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in want:
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    links = spark.createDataFrame(pairs, f"a {kind}, b {kind}")
    for limit in (components.connected_components.__kwdefaults__["one_task_links"], 0):
        found = components.connected_components(links, one_task_links=limit)
        assert found.schema["node"].dataType == links.schema["a"].dataType
        assert {r["node"]: r["component"] for r in found.collect()} == want and found.count() == len(want)


def test_components_of_few_links_take_few_jobs(spark):
    """Each join that is planned and broadcast costs the driver memory, however small its tables."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        assert components.connected_components(links).count() == 41
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 8


def test_empty_tables_and_missing_ids(spark, empty_docs):
    assert substring_dedup.digest(empty_docs).isEmpty() and suffix_dedup.digest(empty_docs).isEmpty() and simhash.near_duplicates(empty_docs).isEmpty()
    odd = spark.createDataFrame([(None, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "z")], "doc_id bigint, text string, id string").withColumn("key", F.lit(1)).withColumn("component", F.lit(2))
    assert sorted((str(r["id"]), r["component"]) for r in simhash.near_duplicates(odd).collect()) == [("1", 1), ("1", 1), ("None", 1)]
    alone = spark.createDataFrame([(None, "a b c"), (7, "quite another text of words"), (7, "and one more that shares the id")], "doc_id bigint, text string")
    assert sorted((str(r["id"]), str(r["component"])) for r in simhash.near_duplicates(alone).collect()) == [("7", "7"), ("7", "7"), ("None", "None")]
    assert substring_dedup.digest(odd).count() == 3 and suffix_dedup.digest(odd).count() == 3


@pytest.mark.parametrize("rare", [3, 0])
def test_near_copies_match_brute_force(spark, monkeypatch, rare):
    """Pairs from far below to above the threshold; SimHash at seven bits misses some of those that reach it."""
    import random

    monkeypatch.setattr(near_copies, "RARE", rare)
    rng = random.Random(3)
    line = [f"license{i}" for i in range(25)]
    texts = {}
    for i in range(0, 240, 2):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 150]))]
        if i % 3 == 0:
            w = w[:10] + line + w[10:]
        v = list(w)
        for k in rng.sample(range(len(v)), 1 + i % 7 * len(v) // 150):
            v[k] = "changed"
        texts[i], texts[i + 1] = " ".join(w), " ".join(v)
    cloud = [f"c{i}" for i in range(120)]
    for i in range(30):
        texts[300 + i] = " ".join([*cloud[: 115 - i % 4], f"own{i}", *cloud[116:]])
    texts |= {400: None, 401: "", 402: "two words", 403: "Two  words", 404: texts[0] + " ", 405: " ".join(["same"] * 80)}

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))

    sets = {i: shingles(t) for i, t in texts.items()}
    label, far = {i: i for i in texts}, 0
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                far += bin(brute_fingerprint(texts[a] or "", 5) ^ brute_fingerprint(texts[b] or "", 5)).count("1") > 7
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if c == old else c for i, c in label.items()}
    assert far > 3
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["id"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    assert got == label
    assert near_copies.near_copies(docs.where("false")).isEmpty()


def test_drop_repeats_keeps_rows_without_an_id(spark):
    p = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"head {p} tail"), (2, p), (None, "clean text")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["text"]) for r in substring_dedup.drop_repeats(docs).collect()} == {(1, "head tail"), (None, "clean text")}


def test_near_copies_take_simhash_candidates(spark, monkeypatch):
    """Texts of one fingerprint and of fingerprints a few bits apart are candidates; what they link is checked on the sets."""
    heads = {5: 0b0, 9: 0b0, 7: 0b1011, 3: -1}
    distinct = spark.createDataFrame(list(heads.items()), "sig bigint, fp bigint")
    got = {tuple(r) for r in near_copies.simhash_candidates(distinct).select("a", "b").distinct().collect()}
    assert got == {(5, 9), (5, 7)}
    asked = []
    kept = near_copies.simhash_candidates
    monkeypatch.setattr(near_copies, "simhash_candidates", lambda df: asked.append(df.columns) or kept(df))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words")], "doc_id bigint, text string")
    found = {r["id"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3} and "fp" in asked[0]
