"""Sorting helpers: the results of numpy's own, in less time."""

import numpy as np
import pytest
from linkloom.llm import quality
from linkloom.llm._common import distinct, ordered
from linkloom.llm.jaccard import shingle_hashes


@pytest.mark.parametrize("n, most", [(0, 5), (1, 5), (2, 1), (1000, 50), (20000, 2**63)])
def test_same_as_numpy(n, most):
    rng = np.random.default_rng(n)
    a, b, c = rng.integers(0, most, n, np.uint64), rng.integers(0, 4, n, np.uint64), rng.integers(0, 2, n)
    assert (ordered(a, b, -c) == np.lexsort((-c, b, a))).all()
    assert (distinct(a) == np.unique(a)).all()


def test_features_are_not_hashed():
    """Distinct features came from numpy's hash table, which took a third of the classifier's time."""
    assert "_unique_hash" not in called(lambda: quality.features(b"some words and some more " * 200))


def test_shingles_by_document():
    rng = np.random.default_rng(3)
    words = [[b"w%d" % x for x in rng.integers(0, 9, n)] for n in (0, 40, 2, 5, 1, 3, 300)]
    s, doc = shingle_hashes(words, 3)
    assert (np.lexsort((s, doc)) == np.arange(len(s))).all() and [len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else ()) for w in words] == np.bincount(doc, minlength=7).tolist()


def called(f):
    import cProfile
    import pstats

    p = cProfile.Profile()
    p.runcall(f)
    return " ".join(k[2] for k in pstats.Stats(p).stats)
