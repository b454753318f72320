"""Identity of parameters: freezing, normalising, and a hash that is the same in every session.

A value is written as text in one canonical form and that text is hashed. In the form
lists and tuples are alike, mappings and sets do not depend on order, whole numbers and
other numbers differ even when equal, and what has no form is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from collections.abc import Set as AnySet
from numbers import Integral, Number, Real
from types import MappingProxyType


def canonical(value) -> str:
    """The text that stands for nested text, numbers, None, mappings, sequences and sets."""
    if value is None:
        return "~"
    if isinstance(value, str):
        return json.dumps(value)
    if isinstance(value, Integral):
        return str(int(value))
    if isinstance(value, Real) or hasattr(value, "as_integer_ratio"):
        return float(value).hex()
    if isinstance(value, Mapping):
        return "{" + ",".join(sorted(f"{canonical(k)}:{canonical(v)}" for k, v in value.items())) + "}"
    if isinstance(value, AnySet):
        return "<" + ",".join(sorted(map(canonical, value))) + ">"
    if isinstance(value, Sequence) and not isinstance(value, (bytes, bytearray)):
        return "[" + ",".join(map(canonical, value)) + "]"
    raise TypeError(f"no identity for a {type(value).__name__}")


def stable_hash(value) -> int:
    """63 bits of the canonical form, not negative."""
    return int.from_bytes(hashlib.blake2b(canonical(value).encode(), digest_size=8).digest(), "big") >> 1


def normalize(value):
    """Parameters as they are stored: numbers, text, tuples of them, mappings of them.
    Anything else, sets and None included, is an error."""
    if isinstance(value, (str, Number)):
        return value
    if isinstance(value, Mapping):
        return Frozen({str(k): normalize(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return tuple(normalize(v) for v in value)
    raise ValueError(f"a parameter is a number, text, or a list or mapping of such, not {type(value).__name__}")


class Frozen(Mapping):
    """A mapping that does not change and can be a key; order does not count."""

    def __init__(self, items: Mapping = MappingProxyType({})):
        self._items = dict(items)

    def __getitem__(self, key):
        return self._items[key]

    def __iter__(self):
        return iter(self._items)

    def __len__(self):
        return len(self._items)

    def __hash__(self):
        return hash(frozenset(self._items.items()))

    def __eq__(self, other):
        return isinstance(other, Mapping) and dict(self) == dict(other)

    def __repr__(self):
        return f"Frozen({self._items!r})"

    def __or__(self, other):
        return Frozen({**self._items, **other})


def freeze(value):
    """Nested mappings, lists and sets in forms that do not change."""
    if isinstance(value, Mapping):
        return Frozen({k: freeze(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return tuple(freeze(v) for v in value)
    if isinstance(value, (set, frozenset)):
        return frozenset(freeze(v) for v in value)
    return value


def unfreeze(value):
    if isinstance(value, Mapping):
        return {k: unfreeze(v) for k, v in value.items()}
    if isinstance(value, tuple):
        return [unfreeze(v) for v in value]
    if isinstance(value, frozenset):
        return {unfreeze(v) for v in value}
    return value


def positive(value, name: str) -> int:
    """An integer above 0."""
    if not isinstance(value, int) or isinstance(value, bool):
        raise ValueError(f"{name} must be an integer, not {value!r}")
    if value <= 0:
        raise ValueError(f"{name} must be above 0, not {value}")
    return value
