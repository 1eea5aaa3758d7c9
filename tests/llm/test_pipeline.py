"""The corpus pipeline's decisions on planted cases."""

import random

import pytest

import corpus_pipeline


@pytest.fixture()
def planted(spark, tables):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage, exam = prose(70), prose(30)
    rows = [(i, prose(120)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, " ".join(rows[4][1].split()[:-1] + ["changed"])), (102, prose(40) + " " + passage + " " + prose(40)), (103, prose(50) + " " + passage), (104, prose(60) + " " + exam + " " + prose(60)), (105, "too short"), (106, None), (107, exam)]
    rows += [(200 + i, " ".join(w + "***" for w in prose(60).split())) for i in range(30)]
    rows += [(300 + i, prose(60)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, ("en", "de", "es", "fr")[i % 4], "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(200 + i, 0, 0) for i in range(30)] + [(300 + i, 1, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, exam)], "item_id bigint, text string")
    return tables(documents=docs, labels=labels, benchmark=bench), passage, exam, dict(rows)


def test_stages_take_effect(spark, planted):
    sf_dir, passage, exam, texts = planted
    assert len(corpus_pipeline.STAGES) == 5
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert not {100, 101, 105, 106, 107} & set(out)
    assert passage not in out[102]["text"] and passage not in out[103]["text"] and exam not in out[104]["text"]
    clean = [i for i in range(60) if i not in (3, 4)]
    assert all(out[i]["text"] == texts[i] for i in clean) and {3, 4} <= set(out)
    assert all(r["n_chars"] == len(r["text"]) and r["rate"] >= 0 for r in out.values())
    assert len([i for i in out if i >= 300]) == 300


def test_every_stage_takes_an_empty_table(spark, planted):
    sf_dir = planted[0]
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).isEmpty(), name


def test_near_copies_in_the_whole_range_go(spark):
    """Eight tenths of the shingles and more: 64 bits put several of these pairs over seven bits apart."""
    rng = random.Random(2)
    rows = []
    for i in range(0, 80, 2):
        w = ["".join(rng.choice("aeiounrst") for _ in range(6)) for _ in range(100)]
        rows.append((i, " ".join(w)))
        for k in (20, 60):
            w[k] = "changed"
        rows.append((i + 1, " ".join(w)))
    w = ["".join(rng.choice("aeiounrst") for _ in range(6)) for _ in range(100)]
    rows += [(80, " ".join(w)), (81, " ".join([*w[:80], *(x[::-1] for x in w[80:])]))]  # 76 of 116 shingles: under the range
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {*range(0, 80, 2), 80, 81}


def test_rows_without_ids_repeats_and_shared_ids(spark):
    """Stages 2 and 5 on their own: nothing of a different text is lost, of equal rows and near copies one stays."""
    rng = random.Random(12)
    a, b, c = (" ".join("".join(rng.choice("aeiounrst") for _ in range(6)) for _ in range(80)) for _ in range(3))
    near = " ".join([*c.split()[:-1], "changed"])
    rows = [(1, a), (1, a), (1, b), (None, c), (None, near), (None, c), (3, near), (4, None), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 7) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, id int")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (3, near), (4, None)], key=str)
    mixed = corpus_pipeline.mixture(spark, docs, "").collect()
    assert len(mixed) == len(rows) and all(r["rate"] >= 0 and r["n_copies"] >= 0 for r in mixed)
    cut = corpus_pipeline.repeats(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in cut if r["text"]) == [(1, b)] and len([r for r in cut if not r["text"]]) == 3
