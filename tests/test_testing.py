import pytest

from causalframe.testing import assert_error_or_return, assert_call, assert_equal


def test_assertions(spark):
    a = spark.range(3)
    assert_equal(a, a.orderBy("id"))
    for left, right in ((a, spark.range(2)), (a, a.withColumnRenamed("id", "x")), (a, 3), (1, 2)):
        with pytest.raises(AssertionError):
            assert_equal(left, right)
    assert_call(int, 3, "3")
    assert_call(int, ValueError, "x")
    assert_call(int, ValueError("invalid literal"), "x")
    for expect in (KeyError("no"), ValueError("other text")):
        with pytest.raises((AssertionError, ValueError)):
            assert_call(int, expect, "x")
    with pytest.raises(AssertionError):
        assert_call(int, ValueError, "3")


def test_error_or_return(spark):
    assert assert_error_or_return(int, 7, "7") == 7
    assert isinstance(assert_error_or_return(int, ValueError, "x"), ValueError)
    assert "literal" in str(assert_error_or_return(int, ValueError("invalid literal"), "x"))
    seen = []
    assert_error_or_return(int, 8, "7", compare=lambda a, b: seen.append((a, b)))
    assert seen == [(7, 8)]
    assert_error_or_return(lambda: spark.range(2), spark.range(2))
    for f, expect in ((lambda: int("x"), 7), (lambda: 7, ValueError), (lambda: int("x"), KeyError), (lambda: int("x"), ValueError("other")), (lambda: 7, 8)):
        try:
            assert_error_or_return(f, expect)
        except (AssertionError, ValueError):
            continue
        raise AssertionError("nothing was found wrong")
