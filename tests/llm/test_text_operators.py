"""Rules, languages, pages, archives, leaks, classifier, mixture."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, html_text, language_id, mixing, quality_classifier, quality_rules, warc
from graphloom.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1200):
        good = i % 4 != 0
        text = " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9))) + ("" if good else rng.choice(["***", "$$$", "###"])) for _ in range(rng.randrange(30, 60)))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    labels += [(99999, 1, 0), (5, None, 0), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_rule_measurements_match_brute_force(spark, corpus, labelled, tables):
    more = corpus.unionByName(spark.createDataFrame([(90, "# a\n# a\n\n\n# a \n x|<y>", "en", "s", 0), (91, ("one two three four five six seven eight nine " * 5), "en", "s", 0)], corpus.schema))
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in Q.op1_quality_rules(spark, tables(documents=more, labels=labelled[1])).collect()}
    assert got == {r["doc_id"]: brute_rules(r["text"]) for r in more.collect()}


def test_cutoffs_catch_junk_and_spare_good_documents(labelled):
    docs, labels = labelled
    rows = quality_rules.judge(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").where("quality is not null").groupBy("quality", "kept").count().collect()
    got = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert got.get((1, False), 0) == 0 and got.get((0, True), 0) <= 3


def test_no_labels_and_empty_documents(spark, labelled, empty_docs):
    docs, labels = labelled
    assert quality_rules.judge(docs, labels.where("false")).where("not kept").isEmpty()
    assert quality_rules.judge(empty_docs, labels).isEmpty()
    clash = docs.limit(3).withColumn("id", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit(1))
    assert quality_rules.keep_good(clash, labels.where("false")).columns == clash.columns


@pytest.mark.parametrize("k,n,level", [(0, 100, 0.05), (3, 50, 0.01), (10, 10, 0.05), (0, 0, 0.1)])
def test_upper_bound_is_exact(k, n, level):
    from math import comb

    p = quality_rules.upper_bound(k, n, level)
    if p < 1:
        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(level, rel=1e-6)


def test_paths_are_nested_and_stop_at_the_first_failure():
    import numpy as np

    G = quality_rules.GRID
    counts = {"a": np.zeros((2, G + 1), int), "b": np.zeros((2, G + 1), int)}
    counts["a"][0, 20], counts["a"][1, 2] = 50, 400
    counts["b"][0, 10], counts["b"][0, 2], counts["b"][1, 2], counts["b"][1, 11] = 30, 20, 395, 5
    path = quality_rules.cutoff_path(counts, risk=0.05, price=0.5)
    assert path[0] == {"a": 20} and path[-1] == {"a": 20, "b": 10}
    for x, y in zip(path, path[1:], strict=False):
        assert all(y.get(r, G + 1) <= k for r, k in x.items())
    assert quality_rules.first_points(path, "b")[9:11] == [len(path), len(path) - 1]
    found = np.zeros((2, 2, len(path) + 1), int)
    found[:, 0, 0], found[:, 1, -1], found[0, 0, -2], found[1, 1, -2] = 50, 380, 30, 30
    got = quality_rules.certify(0, path, found, risk=0.05, level=0.02, price=0.5)
    assert got.steps == {"a": 20} and (got.holdout_good, got.holdout_rejected) == (410, 0)
    assert quality_rules.certify(0, path, found // 10, risk=0.05, level=0.02, price=0.5) is None


def test_the_rules_of_a_stratum_together_keep_the_risk():
    """Over many holdouts of a known distribution, the union's true false-rejection rate exceeds the risk as rarely as promised."""
    import numpy as np

    G, R, risk, level = quality_rules.GRID, 8, 0.05, 0.05
    rng = np.random.default_rng(3)

    def draw(n, good):
        noise = rng.exponential(4.0, (n, R)) if good else rng.exponential(9.0, (n, R))
        return np.minimum(noise.astype(int), G)

    everyone = draw(200_000, True)
    broken = used = 0
    for _ in range(150):
        sample = [[draw(400, good) for good in (False, True)] for _ in range(2)]
        marginal = {f"r{k}": np.stack([np.bincount(sample[0][g][:, k], minlength=G + 1) for g in (0, 1)]) for k in range(R)}
        path = quality_rules.cutoff_path(marginal, risk=risk, price=1.0)
        points = {f"r{k}": np.array(quality_rules.first_points(path, f"r{k}")) for k in range(R)}
        counts = np.array([[np.bincount(np.min([points[f"r{k}"][rows[:, k]] for k in range(R)], axis=0), minlength=len(path) + 1) for rows in half] for half in sample])
        got = quality_rules.certify(0, path, counts, risk=risk, level=level, price=1.0)
        if got is not None:
            used += 1
            lost = np.zeros(len(everyone), bool)
            for rule, step in got.steps.items():
                lost |= everyone[:, int(rule[1:])] >= step
            broken += lost.mean() > risk
    assert used > 50 and broken <= 0.05 * 150 + 4


LANGS = {"aa": "lorem dolor amet sitor", "bb": "szcz krzy wodz przy", "cc": "heit ung schaft zeich"}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(LANGS[lang].split()) + rng.choice("aeiou") for _ in range(30)), lang) for i in range(400) for lang in [rng.choice(sorted(LANGS))]]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34 !!", "bb"), (903, "LOREMA DOLORE AMETI " * 3, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_id(spark, tongues, tables):
    rows = Q.op3_language_id(spark, tables(documents=tongues)).join(tongues.withColumnRenamed("lang", "truth"), "doc_id").collect()
    assert len(rows) == 404
    held = [r for r in rows if r["held_out"] and r["truth"] and r["doc_id"] < 900]
    assert sum(r["lang_pred"] == r["truth"] for r in held) / len(held) > 0.98
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["score"] == 0
    assert by[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_without_labels(tongues, empty_docs):
    model = language_id.train(tongues.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(tongues.limit(3), model).collect()} == {"und"}
    assert language_id.identify(empty_docs, model).isEmpty()


def test_grams_are_those_of_the_cleaned_text():
    bins, off = language_id.grams(["Ab1  c", None, "", "é"])
    assert off.tolist() == [0, 5 + 4, 9, 9, 9 + 2 + 1]  # " ab c " has five bigrams and four trigrams
    assert (language_id.grams(["ab c"])[0] == bins[:9]).all()


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a>m</a></nav><article><h1>T &amp; U</h1><p>one  two<br>three</p><p>b</article><footer>f</footer>", "T & U\none two three\nb"),
    ("<div id=side-bar><p>" + "menu " * 40 + "</p></div><div class=content><h1>Head</h1><p>" + "long text here " * 30 + "</p><p>Short.</p><form>x</form></div><div class='comments'><p>" + "hi " * 80 + "</p></div>", "Head\n" + ("long text here " * 30).strip() + "\nShort."),
    ("plain  text", "plain text"),
    ("<p>a<script>var x='</p>'</script>b", "ab"),
    ("", ""),
    (None, ""),
    ("<main><header><h1>H</h1></header><p>x y</p><aside>no</aside></main>", "H\nx y"),
    ("<body><div class=ad>buy<article><p>kept</p></article>", "kept"),
    ("a &lt; b &#233; &nbsp;c", "a < b é c"),
]


def test_html_extraction(spark, tables):
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"], r["url"]) for r in Q.op4_html_extraction(spark, tables(pages=pages)).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == (want, len(want), f"u{i}"), i
    assert html_text.extract(pages.where("false")).isEmpty()


LONG = ("word " * 60).strip()
NAMED = [
    ('<div class="page has-sidebar"><article><p>text</p></article></div>', "text"),
    (f'<div id="share-of-voice" class="content"><p>{LONG}</p></div>', LONG),
    (f'<article><div class="post-header"><h2>Head</h2></div><p>{LONG}</p><div class="share">tweet</div></article>', f"Head\n{LONG}"),
    (f"<main><article><p>{LONG}</p></article><div><p>more stories here</p></div></main>", LONG),
    (f"<main><p>{LONG}</p><p>{LONG}</p><article>teaser</article></main>", f"{LONG}\n{LONG}\nteaser"),
    ("<form id=all><nav>a b</nav><div class=sidebar><ul><li><a>x</a></ul></div><article><p>hello there</p></article></form>", "hello there"),
    (f"<body><div>A {LONG}</div><div>B {LONG[:99]}</div></body>", f"A {LONG}\nB {LONG[:99]}"),
    (f"<header class=site-header>Site</header><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul class=menu><li><a>x</a></li></ul>", f"Head\n{LONG}\nShort.\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='comments'><p>{LONG[:99]}</p></div><svg><text>no</text></svg></article>", LONG),
    ("<svg><g><article><p>never closed</p></article>", "never closed"),
]


@pytest.mark.parametrize("k", range(len(NAMED)))
def test_names_are_a_hint_and_not_a_veto(k):
    assert html_text.main_text(NAMED[k][0]) == NAMED[k][1]


def test_long_and_deep_pages_take_linear_time():
    import time

    for page in ("<div>x" * 100_000, "<div class=ad>x" * 50_000, "<p><tr>" + "<span>" * 50_000 + "<hr>" * 50_000, "<div><svg>" + "<g>" * 50_000 + "</div>" * 50_000, "<ul>" + "<li><a>x" * 50_000):
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 20
    text = "long text " * 200_000
    assert html_text.main_text(f"<nav>n</nav><article><p>{text}</p></article>") == text.strip()


def test_pages_with_clashing_columns_and_repeats(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x", "y"), (1, "u", "<p>a</p>", "x", "y"), (None, None, "<p>b</p>", None, None)], "page_id bigint, url string, html string, id string, text string")
    got = html_text.extract(pages, keep=("url", "page_id")).collect()
    assert sorted((r["text"], r["id"], r["page_id"], r["url"]) for r in got if r["id"]) == [("a", 1, 1, "u")] * 2
    assert [(r["text"], r["id"]) for r in got if r["id"] is None] == [("b", None)]


def test_warc_round_trip(spark, tables):
    htmls = ["<p>é</p>", None, "<p>é</p>", "", "x\r\n\r\nWARC/1.1\r\n", "<p>é</p>"]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://e/{i}", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in Q.op5_warc(spark, tables(pages=pages)).collect()}
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    head = {0: 5, 2: 5, 1: 3}
    assert got == {i: (len((h or "").encode()), digest(h), "revisit" if i in head else "response", head.get(i)) for i, h in enumerate(htmls)}
    assert warc.round_trip(pages.where("false")).isEmpty()


def test_warc_pushes_filters_and_skips_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u1", "abc"), (2, "u2", "abc"), (3, "u3", "def")], "page_id bigint, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    df = warc.read_archives(spark, f"file://{tmp_path}/w")
    some = df.where("record_type = 'revisit' and target_uri in ('u1', 'u3')")
    assert [(r["record_id"], r["refers_to"]) for r in some.collect()] == [("<urn:page:1>", "<urn:page:2>")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.splitlines() if "Filter" in line]
    assert "BatchScan" in plan and not any(f"{c}#" in line and ("IN" in line or "=" in line) for line in above for c in ("record_type", "target_uri"))
    assert {r["payload"] for r in warc.read_archives(spark, f"file://{tmp_path}/w", payload=False).collect()} == {None}
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("content_length",), 1)]))
    assert len(left) == 1 and reader.tests == [("record_type", frozenset(["response"]))]


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(docs, items, n=10):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    windows = {}
    for i, t in items:
        w = ITEM.findall(low(t))
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = ITEM.findall(low(t))
        hit, named = set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    named |= ids
        out[d] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
    return out


def leaks(spark):
    long = " ".join(f"q{i}" for i in range(25))
    items = [(1, long), (2, "Short, item!"), (10, "q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"), (3, None), (4, "..."), (5, "short item"), (6, "ünï cödé")]
    docs = [(1, "x " + long.upper() + " y"), (2, "a short; ITEM here and short"), (3, None), (4, ""), (5, "q1 q2 q3 clean"), (6, "q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 short"), (7, "ÜNÏ cödé ünï-cödé"), (8, long + " " + "filler " * 60)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), docs, items


@pytest.mark.parametrize("block", [16 << 20, 10])
def test_decontamination_matches_brute_force(spark, block):
    docs, items, d, i = leaks(spark)
    found = decontaminate.scan_documents(docs.withColumn("items", F.lit("clash")), items, block_bytes=block).collect()
    got = {r["id"]: (r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in found}
    assert got == brute_leaks(d, i)


def test_decontamination_query_and_cleaning(spark, tables):
    docs, items, d, i = leaks(spark)
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op7_benchmark_decontamination(spark, tables(documents=docs, benchmark=items)).collect()}
    assert got == brute_leaks(d, i)
    clean = {r["doc_id"]: r["text"] for r in decontaminate.scan_documents(docs, items, action="clean").collect()}
    assert clean[8].split() == ["filler"] * 60 and 1 not in clean and clean[5] == d[4][1] and clean[3] is None
    assert brute_leaks(clean.items(), i)[2][1] == 0
    assert decontaminate.scan_documents(docs, items.where("false")).where("n_hit > 0").isEmpty()
    assert decontaminate.scan_documents(docs.where("false"), items).isEmpty()


def test_quality_classifier(spark, labelled, tables):
    docs, labels = labelled
    more = docs.unionByName(spark.createDataFrame([(5000, None, "en", "s", 0), (5001, "", "en", "s", 0)], docs.schema))
    rows = Q.op9_quality_classifier(spark, tables(documents=more, labels=labels)).join(labels, "doc_id", "left").collect()
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) >= 1202


def test_quality_classifier_without_positives(labelled, empty_docs):
    docs, labels = labelled
    assert {r["score"] for r in quality_classifier.score_documents(docs.limit(5), labels.where("quality = 0"), F.lit(True)).collect()} == {0.5}
    assert quality_classifier.score_documents(empty_docs, labels, F.lit(True)).isEmpty()


def test_prior_estimate():
    import numpy as np

    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-4, 1, 4000)
    assert abs(quality_classifier.estimate_prior(p[:2000], np.concatenate([p[2000:2600], n[:1400]])) - 0.3) < 0.05


def test_language_id_beyond_the_old_bound_and_ties(spark, monkeypatch):
    """Seventy languages of one word each; repeated rows, rows without an id, clashing names and a very long text."""
    base = [chr(0x561 + i) * 3 + chr(0x561 + j) * 3 for i in range(10) for j in range(7)]
    rows = [(i * 6 + k, " ".join([w] * (5 + k)), f"l{i:02d}") for i, w in enumerate(base) for k in range(6)]
    rows += [(9000, base[0], None), (9000, base[0], None), (None, base[3] * 1, None), (9001, " ".join([base[5]] * 200_000), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    model = language_id.train(docs, F.lit(True))
    assert len(model.labels) == 70
    got = language_id.identify(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id", "left").collect()
    known = [r for r in got if r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in known) / len(known) > 0.95
    assert len({(r["lang_pred"], r["score"]) for r in got if r["id"] == 9000}) == 1 and [r["lang_pred"] for r in got if r["id"] == 9001] == ["l05"]
    tie = language_id.Model(["a", "b"], model.weights[:1].repeat(2, axis=0), model.bias[:1].repeat(2), 1.0)
    assert tie.predict(["same", "x1"])[0] == ["a", "a"]
    monkeypatch.setattr(language_id, "MAX_CLASSES", 69)
    with pytest.raises(ValueError):
        language_id.train(docs, F.lit(True))


def test_language_scores_match_brute_force(tongues):
    """The sparse sums of the model against a gram-by-gram calculation."""
    import numpy as np

    model = language_id.train(tongues, F.lit(True))
    assert (model.weights == 0).mean() > 0.5  # the elastic net leaves few weights
    for text in ("loremo dolori krzya", "a", "Ung  ung\tSCHAFTE 12"):
        sums = np.array(model.bias, float)
        bins, _ = language_id.grams([text])
        n = len(bins)
        for b in bins.tolist():
            sums = sums + model.weights[:, b].astype(float) / n
        p = np.exp((sums - sums.max()) / model.temperature)
        names, score = model.predict([text])
        assert names == [model.labels[int(p.argmax())]] and score[0] == pytest.approx((p / p.sum()).max(), rel=1e-5)


def brute_mixture(rows, domains, prior, table, default, weight):
    import math

    out = []
    for text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        scores = []
        for k in range(len(domains)):
            mean = sum(table.get(x, default)[k] for x in w) / len(w) if w else 0.0
            scores.append(prior[k] + weight * mean)
        odds = [math.exp(s - max(scores)) for s in scores]
        out.append((len(w), [o / sum(odds) for o in odds]))
    return out


def test_posteriors_match_brute_force(spark, tongues):
    rows = tongues.select(F.col("doc_id").alias("id"), "text")
    sample = mixing.labelled_sample(rows, tongues.where("lang is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")), 4000)
    table, default, prior = mixing.fit_table(sample.where("not held"), ["aa", "bb", "cc"])
    found = {r["id"]: r for r in mixing.evidence(rows, table, default, "id").select("id", "n_tokens", mixing.posterior(prior, 3.0).alias("p")).collect()}
    texts = {r["id"]: r["text"] for r in rows.collect()}
    vocabulary = sorted({x for t in texts.values() if t for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x})
    bins = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BINS)).alias("b")).collect()}
    by_bin = {r["bin"]: [r["e0"], r["e1"], r["e2"]] for r in table.collect()}
    learned = Counter()
    for r in sample.where("not held").collect():
        learned.update((bins[x], r["domain"]) for x in re.split(r"[\x20\x09-\x0D]+", (r["text"] or "").lower()) if x)
    totals = [sum(n for (_, d), n in learned.items() if d == k) + 0.1 * mixing.BINS for k in ("aa", "bb", "cc")]
    import math

    for b, e in by_bin.items():
        assert e == pytest.approx([math.log((learned[b, d] + 0.1) / totals[k]) for k, d in enumerate(("aa", "bb", "cc"))])
    want = brute_mixture(texts.values(), "abc", prior, {w: by_bin[b] for w, b in bins.items() if b in by_bin}, default, 3.0)
    for i, (n, p) in zip(texts, want, strict=True):
        assert found[i]["n_tokens"] == n and found[i]["p"] == pytest.approx(p, abs=1e-9)


def test_mixing_meets_its_targets(tongues):
    target = {"aa": 0.6, "bb": 0.3, "cc": 0.1, "zz": 0.5}
    rows = mixing.mix(tongues, tongues.select("doc_id", F.col("lang").alias("domain")), target).collect()
    assert len(rows) == tongues.count() and rows[0]["domains"] == ["aa", "bb", "cc"]
    made = [sum(r["n_tokens"] * r["p"][k] * r["rate"] for r in rows) for k in range(3)]
    for k, share in enumerate((0.6, 0.3, 0.1)):
        assert made[k] / sum(made) == pytest.approx(share, abs=0.01) and rows[0]["shares"][k] == pytest.approx(share, abs=0.01)
    assert all(r["rate"] >= 0 and abs(r["n_copies"] - r["rate"]) < 1 for r in rows)
    assert sum(made) == pytest.approx(sum(r["n_tokens"] for r in rows), rel=0.01)
    by = {r["id"]: r for r in rows}
    assert by[900]["n_tokens"] == 0 and by[903]["p"][0] > 0.9


def test_domains_without_a_target_are_told_apart(tongues):
    """``cc`` has labels and no target: its documents are not taken for the others', and a fifth never learned from is predicted."""
    labels = tongues.where("doc_id % 5 <> 0").select("doc_id", F.col("lang").alias("domain"))
    rows = mixing.mix(tongues, labels, {"aa": 1.0, "bb": 3.0}).collect()
    truth = {r["doc_id"]: r["lang"] for r in tongues.collect()}
    assert rows[0]["domains"] == ["aa", "bb", None]
    unseen = [(r, truth[r["id"]]) for r in rows if r["id"] < 900 and r["id"] % 5 == 0]
    assert sum(r["p"].index(max(r["p"])) == ("aa", "bb", "cc").index(t) for r, t in unseen) / len(unseen) > 0.95
    made = {d: sum(r["n_tokens"] * r["rate"] for r in rows if truth[r["id"]] == d and r["id"] < 900) for d in ("aa", "bb", "cc")}
    assert made["bb"] / made["aa"] == pytest.approx(3.0, rel=0.1) and made["cc"] < 0.05 * made["aa"]


def test_mixing_without_labels_or_rows(tongues, empty_docs):
    none = tongues.select("doc_id", F.lit(None).cast("string").alias("domain"))
    assert {r["rate"] for r in mixing.mix(tongues, none, {"aa": 1.0}).collect()} == {1.0}
    assert mixing.mix(empty_docs, none, {"aa": 1.0}).isEmpty()
    clash = tongues.withColumn("id", F.lit(3)).withColumn("rate", F.lit(7)).withColumn("p", F.lit("x")).withColumn("bin", F.lit(1))
    assert mixing.mix(clash, clash.select("doc_id", F.col("lang").alias("domain")), {"aa": 1.0, "bb": 1.0}, steps=3).count() == clash.count()
    with pytest.raises(ValueError):
        mixing.mix(tongues, none, {f"d{i}": 1.0 for i in range(mixing.MAX_DOMAINS + 1)})


def test_own_posteriors_are_those_of_the_rows_and_plan_small(spark):
    """The weights' posteriors at once are the same numbers, and their plan grows with the classes, not with their square."""
    names, prior = ["aa", "bb", "cc", "dd", None], [-1.0, -1.5, -2.0, -0.7, -3.0]
    rows = [((["aa", "bb", "cc", "dd", None, "other"][i % 6]), [-9.0 + (i * k) % 7 / 3 for k in range(5)]) for i in range(24)]
    scored = spark.createDataFrame(rows, "domain string, e array<double>")
    found = mixing._own_posteriors(scored, names, prior)
    for i, w in enumerate(mixing.WEIGHTS):
        p = [list(r.p) for r in scored.select(mixing.posterior(prior, w).alias("p")).collect()]
        assert [r[f"w{i}"] for r in found.collect()] == [p[n][names.index(d)] if d in names else None for n, (d, _) in enumerate(rows)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("e[") <= len(mixing.WEIGHTS) * len(names)


def test_mixing_takes_repeated_rows_and_very_long_texts(spark, tongues):
    long = "lorema dolore " * 100_000
    docs = tongues.select("doc_id", "text").unionByName(spark.createDataFrame([(5000, long), (1, "lorema"), (1, "lorema"), (None, "szcza"), (None, "szcza")], "doc_id bigint, text string"))
    rows = mixing.mix(docs, tongues.select("doc_id", F.col("lang").alias("domain")), {"aa": 1.0, "bb": 1.0, "cc": 1.0}).collect()
    assert len(rows) == docs.count() and [r["n_tokens"] for r in rows if r["id"] == 5000] == [200_000]
    assert len([r for r in rows if r["id"] is None]) == 2 and len({tuple(r["p"]) for r in rows if r["id"] is None}) == 1


def test_very_long_texts_and_repeated_rows(spark, labelled):
    """Rules, leaks and the classifier on texts of many blocks, rows that occur twice, rows without an id and clashing names."""
    docs, labels = labelled
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = [(7000, long), (7001, "x" * 3_000_000), (7002, "alpha beta gamma"), (7002, "alpha beta gamma"), (None, "delta " * 30), (None, None)]
    odd = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema).withColumn("id", F.lit("x")).withColumn("score", F.lit("x")).withColumn("base_failed", F.lit(3))
    got = quality_rules.judge(odd, labels).collect()
    want = sorted((str(i), *brute_rules(t)) for i, t in rows)
    assert sorted((str(r["id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200, 215))), (2, "alpha beta"), (2, "alpha beta"), (None, "delta delta delta")], "item_id bigint, text string")
    found = decontaminate.scan_documents(odd, items).collect()
    by = sorted((str(r["id"]), r["n_words"], r["n_hit"], r["items"]) for r in found)
    assert by == [("7000", 400_000, 80 * 15, ["1"]), ("7001", 1, 0, []), ("7002", 3, 2, ["2"]), ("7002", 3, 2, ["2"]), ("None", 0, 0, []), ("None", 30, 30, [])]
    whole = docs.unionByName(odd.select(*docs.columns)).withColumn("id", F.lit("x")).withColumn("quality", F.lit("x")).withColumn("score", F.lit("x"))
    scored = [r for r in quality_classifier.score_documents(whole, labels, F.lit(True)).collect() if r["id"] is None or r["id"] >= 7000]
    assert len(scored) == 6 and all(0 <= r["score"] <= 1 for r in scored) and len({r["score"] for r in scored if r["id"] == 7002}) == 1


def test_scores_match_brute_force_network(spark, labelled):
    """The scores of the query against the network's formula on statistics taken text by text."""
    import numpy as np
    import pyarrow as pa

    docs, labels = labelled
    features = quality_classifier.measured(docs).cache()
    net, prior = quality_classifier.train(features, labels.select(F.col("doc_id").alias("id"), "quality"), F.lit(True))
    assert 0.5 < prior <= 0.98
    got = {r["id"]: r["score"] for r in quality_classifier.score_documents(docs, labels, F.lit(True)).collect()}
    for r in docs.limit(25).collect():
        x = quality_classifier.statistics(pa.array([r["text"]]))[0].astype(float)
        hidden = [np.tanh(sum(np.clip((x[i] - net.mean[i]) / net.scale[i], -8, 8) * net.w1[i, k] for i in range(len(x))) + net.b1[k]) for k in range(net.w1.shape[1])]
        raw = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-raw)), rel=1e-6)


def test_archives_of_repeated_missing_and_long_pages(spark, tables):
    long = "<p>" + "long " * 1_000_000
    rows = [(1, "u", "a"), (1, "u", "a"), (2, None, long), (3, "w", long), (None, "n", "a"), (4, "\u00fc x\r\ny", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x")).withColumn("head", F.lit(9)).withColumn("refers_to", F.lit("x"))
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in Q.op5_warc(spark, tables(pages=pages)).collect())
    assert got == [(1, 1, "response", None), (1, 1, "response", None), (2, len(long), "revisit", 3), (3, len(long), "response", None), (4, 0, "response", None)]
