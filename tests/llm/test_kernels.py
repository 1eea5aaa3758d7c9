import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import kernels as K
from graphloom.llm.repeats import anchor_runs, merge
from graphloom.llm.simhash import _chain_holds, majority_bits, segment_bounds, segment_count


@given(st.lists(st.text(alphabet="aA\x1c \n\té", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_tokens_are_those_of_the_pattern(texts):
    import re

    buf, off = K.raw_bytes(pa.array(texts, pa.string()))
    starts, ends, count = K.tokens(buf, off, K.SPACE_WORD)
    got = [[bytes(buf[starts[i] : ends[i]]).decode() for i in range(a, b)] for a, b in zip(count[:-1], count[1:], strict=True)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_window_hashes_agree_with_equality(codes, width):
    h = K.window_hashes(np.array(codes, np.uint64), width)
    assert len(h) == max(0, len(codes) - width + 1)
    seen = {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(x, codes[i : i + width]) == codes[i : i + width]


@given(st.lists(st.integers(0, 2), min_size=12, max_size=80))
@settings(max_examples=60, deadline=None)
def test_equal_windows_pick_equal_anchors(codes):
    c = np.array(codes, np.uint64)
    key, lo, n, place = anchor_runs(c, np.array([0, len(c)]), 10, 4)
    assert int(n.sum()) == len(codes) - 9
    of = {}
    for k, a, m in zip(key.tolist(), lo.tolist(), n.tolist(), strict=True):
        for i in range(a, a + m):
            assert of.setdefault(tuple(codes[i : i + 10]), k) == k
    assert (lo + n - 1 <= place).all() and (place + 4 <= lo + 10).all()


def test_blocks_keep_whole_texts():
    texts = ["a" * 10, "", None, "b" * 100, "c"]
    got = [(lo, hi, bytes(buf).decode()) for lo, hi, buf, _ in K.blocks(pa.array(texts), limit=16)]
    assert "".join(x for _, _, x in got) == "".join(t or "" for t in texts) and got[-1][1] == 5


def test_majority_counts_more_than_255_hashes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    off = np.array([0, 600, 600, 1000])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a:z].tolist()) > z - a) for a, z in ((0, 600), (600, 600), (600, 1000))]
    assert majority_bits(h, off).tolist() == want


@pytest.mark.parametrize("t", [0, 1, 4, 7])
def test_a_chain_exists_for_every_close_pair(spark, t):
    rng = np.random.default_rng(t)
    pairs = []
    for _ in range(60):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(63, t, replace=False):
            b ^= 1 << int(bit)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert df.where(_chain_holds(df.a, df.b, t)).count() == len(pairs)
    assert sum(bits for _, bits in segment_bounds(segment_count(t))) == 64


def test_merge():
    assert merge([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]
