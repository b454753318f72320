"""Assertions for tests of tasks and operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from causalframe.timeframe import equals


def assert_equal(left: Any, right: Any) -> None:
    """Equality; DataFrames by schema and rows."""
    if isinstance(left, DataFrame) or isinstance(right, DataFrame):
        assert isinstance(left, DataFrame) and isinstance(right, DataFrame) and equals(left, right), "frames differ"
    else:
        assert left == right, f"{left!r} is not {right!r}"


def assert_call(function: Callable, expect: Any, *args, **kwargs) -> None:
    """The call returns what is expected, or raises it: an exception type, or an exception
    whose message is a pattern of the one raised."""
    if isinstance(expect, type) and issubclass(expect, BaseException):
        kind, pattern = expect, ""
    elif isinstance(expect, BaseException):
        kind, pattern = type(expect), str(expect)
    else:
        assert_equal(function(*args, **kwargs), expect)
        return
    try:
        found = function(*args, **kwargs)
    except kind as e:
        assert re.search(pattern, str(e)), f"{e} does not match {pattern!r}"
    else:
        raise AssertionError(f"returned {found!r} instead of raising {kind.__name__}")


def assert_error_or_return(function: Callable, expect: Any, *args, compare: Callable[[Any, Any], Any] = assert_equal, **kwargs) -> Any:
    """As assert_call, with a comparison of one's own for what is returned. Gives back the
    value, or the exception that was raised as expected."""
    wanted = isinstance(expect, BaseException) or (isinstance(expect, type) and issubclass(expect, BaseException))
    try:
        found = function(*args, **kwargs)
    except Exception as e:
        kind = expect if isinstance(expect, type) else type(expect)
        if not wanted or not isinstance(e, kind):
            raise
        assert isinstance(expect, type) or re.search(str(expect), str(e)), f"{e} does not match {str(expect)!r}"
        return e
    assert not wanted, f"returned {found!r} instead of raising {expect!r}"
    compare(found, expect)
    return found
