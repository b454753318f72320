"""What the row-wise text scanners share: they read (doc_id, text) once, without a
shuffle, and give one row for each input row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalframe.llm import common

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, find: Callable[[str, dict[str, bool]], tuple[list[Span], list[Span]]], base: tuple[str, ...], more: tuple[str, ...], hints: dict[str, str]) -> DataFrame:
    """One row for each row of docs: doc_id, the number of spans of each base kind,
    base_sha256, spans (text), n_spans, found (kind, start, end, value).

    hints: linear-time patterns of which a text must match at least one to be worth
    the Python search; find gets which of them matched and gives base and added spans."""
    kinds = base + more
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in base), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    schema = pa.schema([*fields, ("found", span_type)])
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in common.text_slices(batches):
            texts = pc.fill_null(b.column(1), "")
            matched = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in hints.items()}
            n = b.num_rows
            counts = {k: [0] * n for k in base}
            sha, joined, found = [empty] * n, [""] * n, [[] for _ in range(n)]
            some = [i for i in range(n) if any(m[i] for m in matched.values())]
            for i in some:
                text = texts[i].as_py()
                own, added = find(text, {k: bool(m[i]) for k, m in matched.items()})
                own, spans = ordered(own, kinds), ordered(own + added, kinds)
                for k, _, _ in own:
                    counts[k][i] += 1
                sha[i], joined[i] = hashlib.sha256(digest(own).encode()).hexdigest(), digest(spans)
                found[i] = [{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in spans]
            yield common.batch(schema, b.column(0), *counts.values(), sha, joined, list(map(len, found)), found)

    columns = ", ".join(["doc_id long", *(f"n_{k} long" for k in base), "base_sha256 string", "spans string", "n_spans long", "found array<struct<kind:string,start:int,end:int,value:string>>"])
    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, columns)
