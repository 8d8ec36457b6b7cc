import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from quillstone.functions import likeness

ODD = ["", "x" * 64, "x" * 65, "a" * 250 + "b", "b" * 250 + "a", "é", "a\0b", "\0"]


@pytest.mark.parametrize("least", [0.0, 0.5, 0.65, 0.9, 1.0])
def test_equals_difflib(least):
    r = random.Random(5)
    a, b = ([*ODD, *("".join(r.choices("ab c", k=r.choice((r.randrange(30), r.randrange(50, 200))))) for _ in range(40))] for _ in range(2))
    i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    want = np.array([SequenceMatcher(None, a[x], b[y]).ratio() if a[x] and b[y] else 0.0 for x, y in zip(i, j)])
    at, score = likeness.ratios(likeness.Strings(a), likeness.Strings(b), i, j, np.full(len(i), least))
    assert at.tolist() == np.flatnonzero(want >= least).tolist() and score.tolist() == want[at].tolist()


def test_nothing_to_compare():
    none = np.array([], dtype=np.int64)
    at, score = likeness.ratios(likeness.Strings([]), likeness.Strings(["a"]), none, none, none)
    assert len(at) == len(score) == 0
