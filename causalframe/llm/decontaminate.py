"""Benchmark decontamination with a distributed positional inverted index.

`build_index` turns training texts into immutable index segments: for every term
of a segment its postings, as delta-coded word positions. Segments are stored
rows; each covers whole documents and about `SEGMENT_WORDS` words, so an index of
any size is read segment by segment, without a shuffle.

`search` takes the windows (phrases) of the test items. In each segment it starts
from the postings of a window's rarest term, shifts them by the term's offset and
intersects them with the shifted postings of the next rarest, until all terms are
done. What is left are exact phrase matches; with `slop` each term may also stand
that many words off from where the rarest puts it, within the same document, which
gives the proximity matches.

The test set is sent to the tasks in blocks of bounded size (`BLOCK_WINDOWS`; a long
item is spread over several), and every block meets every segment.

Defined results: a null or empty text has no words and no hits; an item without
words matches nothing; a null item_id is an item of its own, null among the items and
left out of digests; items that repeat count once by item_id; document rows that repeat
are judged separately; extra columns are ignored; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.llm import common

WINDOW_WORDS = 8
SEGMENT_WORDS = 400_000
BLOCK_WINDOWS = 200_000
#: Words that a term may stand off in the query of proximity matches.
NEAR_SLOP = 2

#: terms, their sizes in bytes and numbers of postings, all positions (delta-coded
#: within a term); then the first document's row number, and each document's id and its
#: first position.
_SEGMENT = "terms binary, term_bytes binary, term_counts binary, positions binary, rid long, doc_ids array<long>, doc_first binary"
_SEGMENT_ARROW = pa.schema([("terms", pa.binary()), ("term_bytes", pa.binary()), ("term_counts", pa.binary()), ("positions", pa.binary()), ("rid", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_first", pa.binary())])


def _segment(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]], rid: int) -> pa.RecordBatch:
    """parts: (ids, bytes, offsets) of some documents."""
    ids = [i for p in parts for i in p[0].to_pylist()]
    data = np.concatenate([p[1] for p in parts])
    ends = np.cumsum([0, *(len(p[1]) for p in parts)])
    offsets = np.concatenate([[0], *(p[2][1:] + base for p, base in zip(parts, ends, strict=False))]).astype(np.int64)
    s, e, first = common.words(data, offsets, common.ALNUM)
    codes, terms = common.word_codes(data, s, e)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    counts = np.bincount(codes, minlength=len(terms)).astype(np.int32)
    delta = np.diff(order, prepend=np.int32(0))
    heads = np.cumsum(counts) - counts
    delta[heads] = order[heads]
    blob, at = common.text_bytes(terms)
    return common.batch(_SEGMENT_ARROW, [blob.tobytes()], [np.diff(at).astype(np.int32).tobytes()], [counts.tobytes()], [delta.tobytes()], [rid], [ids], [first.astype(np.int32).tobytes()])


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of docs (doc_id, text), one row for each segment. Documents are numbered
    here, once: whoever reads the stored index finds the same numbers."""

    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        parts, held = [], 0
        for b in common.text_slices(batches):
            data, offsets = common.text_bytes(b.column(1))
            parts.append((b.column(0), common.lower(data), offsets))
            held += len(data)
            if held >= segment_words * 6:
                yield _segment(parts, rid)
                rid += sum(len(p[0]) for p in parts)
                parts, held = [], 0
        if parts:
            yield _segment(parts, rid)

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _SEGMENT)


def item_words(text: str | None) -> list[bytes]:
    data = common.lower(np.frombuffer((text or "").encode(), np.uint8))
    s, e, _ = common.words(data, np.array([0, len(data)]), common.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s, e, strict=True)]


class Windows:
    """The phrases of a block of test items (item, words), one row each; short items are
    padded with -1."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window_words: int = WINDOW_WORDS):
        vocabulary: dict[bytes, int] = {}
        rows, owners = [], []
        self.names = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        at = {x: k for k, x in enumerate(self.names)}
        for item, words in items:
            codes = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            for k in range(max(1, len(codes) - window_words + 1) if codes else 0):
                rows.append((codes[k : k + window_words] + [-1] * window_words)[:window_words])
                owners.append(at[item])
        self.terms = pa.array(list(vocabulary), pa.large_binary())
        grid, inverse = np.unique(np.array(rows, np.int32).reshape(-1, window_words), axis=0, return_inverse=True) if rows else (np.zeros((0, window_words), np.int32), np.zeros(0, int))
        self.grid, self.sizes = grid, (grid >= 0).sum(1)
        # Which items have a window: sorted by window.
        order = np.argsort(inverse.ravel(), kind="stable")
        self.owners, self.owner_first = np.array(owners, np.int32)[order], np.searchsorted(inverse.ravel()[order], np.arange(len(grid) + 1))


def _matches(segment: dict, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of exact matches, (window, place of its rarest term) of proximity matches."""
    import pyarrow.compute as pc

    sizes = np.frombuffer(segment["term_bytes"], np.int32)
    counts = np.frombuffer(segment["term_counts"], np.int32).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(segment["terms"])])
    first = np.frombuffer(segment["doc_first"], np.int32)
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(windows.grid):
        return none, none, none, none
    local = pc.fill_null(pc.index_in(windows.terms, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    grid = np.where(windows.grid >= 0, local[windows.grid], -2)
    alive = np.flatnonzero((grid != -1).all(1))
    if not len(alive):
        return none, none, none, none
    grid = grid[alive]
    delta = np.frombuffer(segment["positions"], np.int32).astype(np.int64)
    heads = np.cumsum(counts) - counts
    total = np.cumsum(delta)
    positions = total - np.repeat(total[heads] - delta[heads], counts)
    span = np.int64(len(positions) + 2 * slop + windows.grid.shape[1] + 2)
    keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * span + positions
    # Rarest terms first; padding goes last.
    rank = np.argsort(np.where(grid >= 0, counts[grid.clip(0)], np.iinfo(np.int64).max), axis=1, kind="stable")
    row = np.arange(len(grid))
    term, off = grid[row, rank[:, 0]], rank[:, 0]
    n = counts[term]
    w = np.repeat(row, n)
    place = positions[np.repeat(heads[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    start = place - off[w]
    doc = np.searchsorted(first, place, side="right") - 1
    size = windows.sizes[alive]
    exact = (start >= first[doc]) & (start + size[w] <= first[doc + 1])
    if not slop:
        w, start, place, doc, exact = w[exact], start[exact], place[exact], doc[exact], exact[exact]
    for k in range(1, grid.shape[1]):
        t, o = grid[w, rank[w, k]], rank[w, k]
        used = t >= 0
        term_key = np.where(used, t, 0) * span
        goal = term_key + start + o
        if slop:
            # A term of the neighbouring text does not count.
            at = np.searchsorted(keys, np.maximum(goal - slop, term_key + first[doc]))
            ok = ~used | ((at < len(keys)) & (keys[at.clip(max=len(keys) - 1)] <= np.minimum(goal + slop, term_key + first[doc + 1] - 1)))
        at = np.searchsorted(keys, goal)
        hit = ~used | ((at < len(keys)) & (keys[at.clip(max=len(keys) - 1)] == goal))
        exact &= hit
        keep = ok if slop else hit
        w, start, place, doc, exact = w[keep], start[keep], place[keep], doc[keep], exact[keep]
    return alive[w[exact]], start[exact], alive[w], place


_FOUND = "rid long, doc_id long, n_words long, n_hit long, items array<string>, n_near long, hits array<int>"
_FOUND_ARROW = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("n_near", pa.int64()), ("hits", pa.list_(pa.int32()))])


def search(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """One row for each document of the index: rid (its number), doc_id, n_words, n_hit,
    items (ids as strings, sorted, null last), n_near (proximity matches, the exact ones
    included), hits (positions of hit words)."""

    def run(batches):
        for b in batches:
            for segment in b.to_pylist():
                first = np.frombuffer(segment["doc_first"], np.int32)
                w, start, near_w, near = _matches(segment, windows, slop)
                docs = len(first) - 1
                mark = np.zeros(first[-1] + 1, np.int32)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + windows.sizes[w], -1)
                hit = np.cumsum(mark)[:-1] > 0
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_near = np.bincount(np.searchsorted(first, near, side="right") - 1, minlength=docs) if len(near) else np.zeros(docs, int)
                items: list[list[str | None]] = [[] for _ in range(docs)]
                hits: list[list[int]] = [[] for _ in range(docs)]
                if len(w):
                    doc = np.searchsorted(first, start, side="right") - 1
                    n = windows.owner_first[w + 1] - windows.owner_first[w]
                    owner = windows.owners[np.repeat(windows.owner_first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    for d, o in np.unique(np.stack([np.repeat(doc, n), owner], 1), axis=0):
                        items[d].append(windows.names[o])
                    for p in np.flatnonzero(hit):
                        d = int(np.searchsorted(first, p, side="right")) - 1
                        hits[d].append(int(p - first[d]))
                yield common.batch(_FOUND_ARROW, np.arange(docs) + segment["rid"], segment["doc_ids"], np.diff(first).astype(np.int64), (sums[first[1:]] - sums[first[:-1]]).astype(np.int64), items, n_near.astype(np.int64), hits)

    return common.map_arrow(index, run, _FOUND)


def _blocks(benchmark: DataFrame, window_words: int, block_windows: int) -> Iterator[Windows]:
    """The test set comes to the driver row by row; one block of windows is held at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = item_words(r[1])
        at = 0
        while at == 0 or at <= len(words) - window_words:
            part = words[at : at + block_windows - size + window_words - 1]
            held.append((r[0], part))
            n = max(1, len(part) - window_words + 1)
            at, size = at + n, size + n
            if size >= block_windows:
                yield Windows(held, window_words)
                held, size = [], 0
    yield Windows(held, window_words)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, slop: int = 0, min_items: int = 2, window_words: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items, n_near, hits (positions of
    hit words), contaminated (at least min_items items have occurring windows)."""
    common.tune(spark)
    index = common.store(spark, build_index(docs), "postings", **common.LARGE_ROWS)
    blocks = _blocks(benchmark, window_words, block_windows)
    found, block = search(index, next(blocks), slop), next(blocks, None)
    if block is not None:
        # With more than one block the hits of each are stored; documents without are not.
        every = common.store(spark, found.where("n_hit > 0 or n_near > 0"), "hits")
        while block is not None:
            every = every.unionByName(common.store(spark, search(index, block, slop).where("n_hit > 0 or n_near > 0"), "hits"))
            block = next(blocks, None)
        hits = every.groupBy("rid").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.sum("n_near").alias("n_near"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        )
        known = search(index, Windows([], window_words)).select("rid", "doc_id", "n_words").join(hits, "rid", "left")
        none = F.array().cast("array<string>"), F.array().cast("array<int>")
        found = known.select("rid", "doc_id", "n_words", F.coalesce("items", none[0]).alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("hits", none[1]).alias("hits")).withColumn("n_hit", F.size("hits").cast("long"))
    return found.drop("rid").withColumn("contaminated", F.size("items") >= min_items)


def _judged(spark: SparkSession, sf_dir: str, slop: int, *more: str) -> DataFrame:
    found = decontaminate(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", *more)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return _judged(spark, sf_dir, 0)


def op2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with n_near, the matches in which terms stand up to `NEAR_SLOP` words off."""
    return _judged(spark, sf_dir, NEAR_SLOP, "n_near")


_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(string_split(g, ' ')) AS n FROM bw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) dw JOIN bw ON dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
