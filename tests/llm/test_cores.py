import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillgrid.llm import blocks as B
from quillgrid.llm.cores import MinHasher, core_hashes, core_string, cores, distinct_windows, likeness
from quillgrid.llm.verify import likeness_of_pairs

TEXTS = st.text(alphabet=st.characters(codec="utf-8"), max_size=60)


@given(st.lists(TEXTS, max_size=8))
def test_cores_of_a_batch_are_those_of_its_texts(texts):
    points, owner = cores(texts)
    for k, t in enumerate(texts):
        assert points[owner == k].tobytes().decode("utf-32-le") == core_string(t)


@given(st.lists(TEXTS, min_size=1, max_size=8))
def test_core_hashes_are_equal_for_equal_cores_only(texts):
    hashes, sizes = core_hashes(texts)
    own = [core_string(t) for t in texts]
    assert [len(c) for c in own] == sizes.tolist()
    assert len(set(hashes.tolist())) == len(set(own))


@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=6), st.integers(1, 4))
def test_likeness_of_pairs_is_that_of_sets(pairs, n):
    got = likeness_of_pairs([a for a, _ in pairs], [b for _, b in pairs], n)
    assert got.tolist() == [likeness(a, b, n) for a, b in pairs]


def test_minwise_values_agree_as_often_as_windows_are_shared():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    texts = []
    for _ in range(60):
        same = word(200)
        texts += [same + word(30), same + word(30)]
    docs, values = MinHasher(128).matrix(*distinct_windows(texts, 4))
    real = np.array([likeness(texts[k], texts[k + 1], 4) for k in range(0, 120, 2)])
    seen = (values[0::2] == values[1::2]).mean(axis=1)
    assert docs.tolist() == list(range(120))
    assert abs(real.mean() - seen.mean()) < 0.03


@pytest.mark.parametrize("size", [2, 5, B.GROUP, B.GROUP + 1, 3 * B.GROUP + 7])
def test_every_pair_of_a_run_that_agrees_is_found_once(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = rng.random((size, 64)) < 0.25
    sketch = np.array([base ^ np.uint64(sum(1 << int(b) for b in np.flatnonzero(f))) for f in flips], np.uint64)
    keys = np.full(size, 9, np.uint64)
    got = [(min(i, j), max(i, j)) for a, b in B.pairs_of_runs(keys, sketch, 40) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for i in range(size) for j in range(i + 1, size) if 64 - int(np.bitwise_count(sketch[i] ^ sketch[j])) >= 40}
    assert len(got) == len(set(got)) and set(got) == want


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_columns_come_back(numbers):
    x = np.array(numbers, np.uint64)
    a, b = B.unpack([B.pack([x, x[::-1].copy()])], 2)
    assert a.tolist() == numbers and b.tolist() == numbers[::-1]


def test_a_bitmap_never_misses():
    x = np.arange(0, 5000, 7, dtype=np.uint64)
    one = B.BitmapBuilder(1 << 16)
    one.add(x)
    assert B.in_bitmap(one.bytes, x).all()
    assert not B.in_bitmap(one.bytes, np.arange(10**9, 10**9 + 5000, dtype=np.uint64)).all()
    assert B.bitmap_bits(10**15) <= B.BROADCAST_LIMIT * 8
