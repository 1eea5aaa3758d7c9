import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, base="w"):
    return [f"{base}{rng.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, nulls, empties and odd white space."""
    rng = random.Random(5)
    passage = words(rng, 60, "p")
    rows = []
    for i in range(40):
        t = words(rng, rng.choice([5, 40, 90, 200]))
        if i % 5 == 0:
            t = t[:20] + passage + t[20:]
        rows.append((i, "  ".join(t) + ("\n" if i % 3 else "\t x")))
    rows += [(40, rows[7][1]), (41, rows[7][1]), (42, rows[9][1].replace("w", "W", 1)), (43, None), (44, ""), (45, " \n\t "), (46, "é" * 130 + " ß" * 90), (47, "é" * 130 + " ß" * 90 + "z")]
    rows += [(48, " ".join(["same"] * 80)), (49, "end " + " ".join(passage)), (50, "x" * 5000), (51, "\x1c\x85".join(words(rng, 50)))]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def tables(tmp_path):
    """Writes DataFrames as a data folder and gives its path."""

    def put(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
