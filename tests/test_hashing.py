from decimal import Decimal

import numpy as np
import pytest

from causalframe.functions.hashing import Frozen, canonical, freeze, normalize, positive, stable_hash, unfreeze

APART = [None, "", "1", 1, 1.0, 2, 0.5, [], [1], [[1]], [1, 2], [2, 1], {}, {"a": 1}, {"a": 1.0}, {"a": {"b": 1}}, {"b": 1}, ["a", 1], frozenset(), frozenset("a"), "[1]", "~", 2**70, -(2**70), 1e200]


def test_different_values_differ():
    assert len({stable_hash(x) for x in APART}) == len({canonical(x) for x in APART}) == len(APART)
    assert all(0 <= stable_hash(x) < 2**63 for x in APART)


@pytest.mark.parametrize(
    "a, b",
    [([1, "x"], (1, "x")), ({"a": 1, "b": [2]}, {"b": (2,), "a": 1}), (Frozen({"a": 1}), {"a": 1}), (frozenset("ab"), frozenset("ba")), (np.int64(7), 7), (np.float64(0.1), 0.1), (True, 1), (Decimal("0.5"), 0.5)],
)
def test_equal_values(a, b):
    assert stable_hash(a) == stable_hash(b)


def test_the_same_in_every_session():
    import subprocess
    import sys

    code = "from causalframe.functions.hashing import stable_hash; print(stable_hash({'a': frozenset('xyz'), 'b': [1, 2.5, None]}))"
    found = {subprocess.run([sys.executable, "-c", code], env={"PYTHONHASHSEED": seed, "PYTHONPATH": "."}, capture_output=True, text=True, check=True).stdout for seed in ("1", "2")}
    assert found == {f"{stable_hash({'b': [1, 2.5, None], 'a': frozenset('zyx')})}\n"}


@pytest.mark.parametrize("value", [object(), b"x", [object()], 1j])
def test_without_identity(value):
    with pytest.raises(TypeError):
        stable_hash(value)


def test_normalize_and_freeze():
    assert normalize({"a": [1, {"b": 2}]}) == Frozen({"a": (1, Frozen({"b": 2}))})
    for bad in ({1, 2}, None, object()):
        with pytest.raises(ValueError):
            normalize({"x": bad})
    assert unfreeze(freeze({"a": [1, 2], "s": {3}})) == {"a": [1, 2], "s": {3}}
    assert hash(freeze({"a": 1, "b": 2})) == hash(freeze({"b": 2, "a": 1}))
    assert positive(3, "n") == 3
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            positive(bad, "n")
