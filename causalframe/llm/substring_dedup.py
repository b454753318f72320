"""Removal of repeated passages with a compressed FM-index per shard.

A window is `WINDOW` consecutive words of a document. A word goes if it lies in a
window whose words also start earlier: in a smaller doc_id, or further up.

A shard is a set of text segments. It is indexed (Burrows-Wheeler transform in a wavelet
tree) and its segments are streamed through backward search, which gives matching
statistics, capped at a window: every window's interval of suffixes. Windows with the same
interval have the same words. Of intervals above one, all but the earliest are reported.

Shards come in two kinds, so that equal windows meet and yet no shard has to be streamed
against all others, nor sees every copy of a hot passage. Three passes over the documents:

1. Anchors. A window's anchor is the smallest hash among its `ANCHOR`-word sequences; equal
   windows have equal anchors, and neighbouring windows mostly share one. Each task sends
   its distinct ones; those that occur twice anywhere are put into a filter.
2. Segments. Windows with such an anchor are in play. Each task's own are a shard; what
   it reports is removed at once, so a passage that a third of all documents share leaves
   a task once. What stays goes to the shard of its anchor; with more than `FAN_IN` tasks
   there first to that of the anchor and FAN_IN tasks, level by level.
3. Texts. Documents with anything to remove, by another filter, are joined with their
   removals; all others are done in the scan.

The filters only ever let too much through, which the shard or the join then undoes.

Defined results: null text has no words; the order of documents is by doc_id, null
first; rows with one doc_id are one document to the order: what starts at the same
place in them does not start earlier; so rows that repeat remove nothing from each
other; extra columns are ignored; texts have no largest length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.llm import common
from causalframe.llm.common import U64
from causalframe.llm.fm_index import FMIndex

WINDOW = 20
ANCHOR = 8
#: Windows of a task's own shard.
TASK_WINDOWS = 1_000_000
#: Windows of a segment of a task's own shard: lanes of the search should be about as long.
PIECE = 200
#: Tasks whose segments meet in one shard.
FAN_IN = 256
#: Bytes of input for each shard of anchors.
SHARD_BYTES = 5 << 19

_SEG = np.dtype([("key_hi", "<u8"), ("key_lo", "<u8"), ("doc", "<i8"), ("known", "<i4"), ("start", "<i4"), ("size", "<i4")])


class Tokens:
    """Words of some rows: byte bounds, hashes, first word of each row."""

    def __init__(self, column: pa.Array):
        self.data, offsets = common.text_bytes(column)
        self.s, self.e, self.first = common.words(self.data, offsets, common.SPACED)
        codes, dictionary = common.word_codes(self.data, self.s, self.e)
        self.h = common.hash_bytes(dictionary)[codes] if len(codes) else np.zeros(0, U64)

    def windows(self, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, anchor and anchor's place of every window that lies in one row."""
        g = common.gram_hash(self.h, m)
        n = len(self.h) - k + 1
        if n <= 0:
            z = np.zeros(0, np.int64)
            return z, np.zeros(0, U64), z
        width, span = k - m + 1, 1
        value, place = g, np.arange(len(g))
        while 2 * span <= width:
            value, place = _least(value[:-span], place[:-span], value[span:], place[span:])
            span *= 2
        if span < width:
            gap = width - span
            value, place = _least(value[:-gap], place[:-gap], value[gap:], place[gap:])
        start = np.arange(n)
        inside = np.zeros(n, bool)
        for a, b in zip(self.first, self.first[1:], strict=False):
            inside[a : max(a, b - k + 1)] = True
        at = np.flatnonzero(inside)
        return start[at], value[at], place[at]


def _least(v: np.ndarray, p: np.ndarray, w: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smaller value and its place, the left one of equal values."""
    left = v <= w
    return np.where(left, v, w), np.where(left, p, q)


def _anchors(docs: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """Packed distinct anchors of each task by bucket; `again` has those seen twice in it."""

    def run(batches):
        once, again = np.zeros(0, U64), np.zeros(0, U64)
        waiting: list[np.ndarray] = []

        def settle() -> None:
            nonlocal once, again
            values, n = np.unique(np.concatenate([once, *waiting]), return_counts=True)
            once, again = values, np.union1d(again, values[n > 1])
            waiting.clear()

        for b in common.text_slices(batches):
            t = Tokens(b.column(1))
            _, _, place = t.windows(k, m)
            place = np.unique(place)
            waiting.append(common.gram_hash(t.h, m)[place] if len(place) else np.zeros(0, U64))
            if sum(map(len, waiting)) > 1_000_000:
                settle()
        settle()
        alone = np.setdiff1d(once, again, assume_unique=True)
        rows = []
        for x, twice in ((alone, False), (again, True)):
            home = (common.mix(x) % U64(buckets)).astype(np.int32)
            order = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[order], np.arange(buckets + 1))
            rows += [(i, twice, x[order[a:b]].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ty) for i, ty in enumerate((pa.int32(), pa.bool_(), pa.binary()))], names=["bucket", "twice", "anchors"])

    return common.map_arrow(docs, run, "bucket int, twice boolean, anchors binary")


def _repeated(key, table):
    """Anchors of a bucket that occur at least twice."""
    twice, blobs = table.column("twice").to_pylist(), table.column("anchors").to_pylist()
    alone = np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for t, x in zip(twice, blobs, strict=True) if not t)])
    again = np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for t, x in zip(twice, blobs, strict=True) if t)])
    values, n = np.unique(alone, return_counts=True)
    again = np.unique(again)
    found = np.concatenate([values[(n > 1) | np.isin(values, again)], again])
    return pa.table({"h": pa.array(np.unique(found).view(np.int64))})


class Shard:
    """Segments (places and their text, one after another), indexed and streamed: seg and
    place of every window, the bytes it covers, and whether it is gone, that is, its words
    also start earlier."""

    def __init__(self, segments: np.ndarray, data: np.ndarray, k: int):
        self.segments = segments
        offsets = np.concatenate([[0], np.cumsum(segments["size"], dtype=np.int64)])
        s, e, first = common.words(data, offsets, common.SPACED)
        codes, _ = common.word_codes(data, s, e)
        n = np.diff(first)
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(first[:-1], n).astype(np.int32)
        at = np.flatnonzero(place <= np.repeat(n, n) - k)
        self.seg, self.place = np.repeat(np.arange(len(n), dtype=np.int32), n)[at], place[at]
        self.start = segments["start"][self.seg] + self.place
        self.lo_byte, self.hi_byte = s[at], e[at + k - 1]
        index = FMIndex(codes, first, k)
        lo, hi = index.stream(codes, first)
        lo, many = lo[at], (hi - lo)[at] > 1
        # The order of places: doc_id (null first), then start; equal ones share a rank.
        by = np.lexsort((segments["doc"], segments["known"]))
        ranked = segments[["known", "doc"]][by]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if len(by) else 0
        order = rank[self.seg[many]] << 32 | self.start[many]
        least = np.full(index.size, np.iinfo(np.int64).max)
        np.minimum.at(least, lo[many], order)
        self.gone = np.zeros(len(at), bool)
        self.gone[many] = order > least[lo[many]]

    def removals(self) -> list[tuple]:
        own = self.segments[self.seg[self.gone]]
        return _removals(own["key_hi"], own["key_lo"], self.start[self.gone])

    def left(self) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Segments of the windows that stay, and the bytes of each."""
        keep = np.flatnonzero(~self.gone)
        head, tail = _runs(self.seg[keep], self.start[keep])
        a, b = self.lo_byte[keep][head], self.hi_byte[keep][tail]
        seg = self.segments[self.seg[keep][head]]
        seg["start"], seg["size"] = self.start[keep][head], b - a
        return seg, list(zip(a.tolist(), b.tolist(), strict=True))


def _runs(row: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of windows that follow one another in a row and have the same values."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return head, np.append(head[1:], len(row))[: len(head)] - 1


class _Chunk:
    """Windows of a task that are in play, with the rows they come from."""

    def __init__(self, k: int, buckets: int, part: int):
        self.k, self.buckets, self.part = k, buckets, part
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []  # (key_hi, key_lo, doc_id or 0, known)
        self.parts: list[tuple] = []  # (row, start in row, anchor, first byte, last byte of text)
        self.texts: list[bytes] = []
        self.held = self.base = 0
        self.keys: set[bytes] = set()

    def add(self, b: pa.RecordBatch, pick: common.Bloom, m: int) -> None:
        t = Tokens(b.column(1))
        start, anchor, _ = t.windows(self.k, m)
        use = pick.has(anchor)
        start, anchor = start[use], anchor[use]
        row = np.searchsorted(t.first, start, side="right") - 1
        keys = common.doc_key(b.column(0), b.column(1))
        # A row that repeats says nothing new.
        fresh = np.zeros(b.num_rows, bool)
        for i in np.unique(row):
            if keys[i] not in self.keys:
                self.keys.add(keys[i])
                fresh[i] = True
        use = fresh[row]
        start, anchor, row = start[use], anchor[use], row[use]
        if not len(start):
            return
        ids = b.column(0).to_pylist()
        own = np.unique(row)
        place = np.zeros(b.num_rows, np.int64)
        place[own] = np.arange(len(own)) + len(self.rows)
        self.rows += [(int.from_bytes(keys[i][:8], "big"), int.from_bytes(keys[i][8:], "big"), ids[i] or 0, ids[i] is not None) for i in own]
        self.parts.append((place[row], start - t.first[row], anchor, t.s[start] + self.base, t.e[start + self.k - 1] + self.base))
        self.texts.append(t.data.tobytes())
        self.base += len(t.data)
        self.held += len(start)

    def flush(self) -> pa.RecordBatch | None:
        """Removals among these windows (k, starts), and the segments of the others by bucket."""
        if not self.parts:
            return None
        # In order of rows, and of places in them.
        row, start, anchor, lo, hi = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        info = np.array(self.rows, [("hi", "<u8"), ("lo", "<u8"), ("doc", "<i8"), ("known", "<i4")])
        text = b"".join(self.texts)

        def cut(row: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            seg = np.zeros(len(row), _SEG)
            i = info[row]
            seg["key_hi"], seg["key_lo"], seg["doc"], seg["known"], seg["start"], seg["size"] = i["hi"], i["lo"], i["doc"], i["known"], start, b - a
            return seg

        head, tail = _runs(row, start)
        head, tail = _runs(row, start, (np.arange(len(row)) - np.repeat(head, tail - head + 1)) // PIECE)
        a, b = lo[head], hi[tail]
        data = np.frombuffer(b"".join([text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]), np.uint8)
        shard = Shard(cut(row[head], start[head], a, b), data, self.k)
        out = [(x[0], self.part, x[1], x[2], None, None) for x in shard.removals()]

        keep = np.flatnonzero(~shard.gone)
        row, start, anchor, lo, hi = (x[keep] for x in (row, start, anchor, lo, hi))
        head, tail = _runs(row, start, anchor)
        a, b = lo[head], hi[tail]
        out += _dealt(cut(row[head], start[head], a, b), list(zip(a.tolist(), b.tolist(), strict=True)), text, (common.mix(anchor[head]) % U64(self.buckets)).astype(np.int64), self.buckets, self.part)
        self.clear()
        return _packed(out)


def _dealt(seg: np.ndarray, spans: list[tuple[int, int]], text: bytes, home: np.ndarray, buckets: int, part: int) -> list[tuple]:
    """Rows of segments, one for each bucket that has some."""
    import zstandard

    by = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], home[by][1:] != home[by][:-1]])) if len(by) else []
    rows = []
    for own in np.split(by, edges[1:]) if len(by) else []:
        body = b"".join([text[x:y] for x, y in (spans[i] for i in own.tolist())])
        rows.append((int(home[own[0]]), part, None, None, seg[own].tobytes(), zstandard.compress(body, 1)))
    return rows


_ROWS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("k", pa.binary()), ("starts", pa.binary()), ("segments", pa.binary()), ("text", pa.binary())])
_ROWS_SQL = "bucket int, part int, k binary, starts binary, segments binary, text binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)


def _removals(hi: np.ndarray, lo: np.ndarray, start: np.ndarray) -> list[tuple]:
    """(spread, k, starts) of windows to remove, one for each document; starts: the first of
    each run of them, and how many they are."""
    if not len(hi):
        return []
    order = np.lexsort((start, lo, hi))
    hi, lo, start = hi[order], lo[order], start[order]
    other = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    new = other.copy()
    new[1:] |= start[1:] != start[:-1] + 1
    head = np.flatnonzero(new)
    runs = np.column_stack([start[head], np.diff(np.append(head, len(start)))]).astype("<i4")
    edge = np.flatnonzero(other[head])
    at = head[edge]
    ends = np.append(edge[1:], len(head))
    return [(int(y & U64(0x3FFFFFFF)), int(x).to_bytes(8, "big") + int(y).to_bytes(8, "big"), runs[a:b].tobytes()) for x, y, a, b in zip(hi[at], lo[at], edge, ends, strict=True)]


def _segments(docs: DataFrame, wanted: np.ndarray, k: int, m: int, buckets: int) -> DataFrame:
    def run(batches):
        pick, chunk = common.Bloom(wanted), _Chunk(k, buckets, TaskContext.get().partitionId())
        for b in common.text_slices(batches):
            chunk.add(b, pick, m)
            if chunk.held > TASK_WINDOWS:
                yield chunk.flush()
        last = chunk.flush()
        if last is not None:
            yield last

    return common.map_arrow(docs, run, _ROWS_SQL).withColumn("bucket", F.pmod("bucket", F.lit(buckets)))


def _meet(k: int, last: bool):
    """Shards of anchors: removals go on as they are; then those of the segments that met,
    and, unless this is the last level, the segments of the windows that stay."""

    def run(key, table):
        import zstandard

        done = table.filter(pc.is_valid(table.column("k")))
        own = table.filter(pc.is_valid(table.column("segments")))
        done = done.select(["k", "starts"] if last else _ROWS.names).cast(pa.schema([f for f in _ROWS if not last or f.name in ("k", "starts")]))
        if not own.num_rows:
            return done
        bucket, part = own.column("bucket")[0].as_py(), own.column("part")[0].as_py()
        # Segments are at least a window long, so texts of several rows do not run together.
        text = b"".join(zstandard.decompress(x) for x in own.column("text").to_pylist())
        shard = Shard(np.concatenate([np.frombuffer(x, _SEG) for x in own.column("segments").to_pylist()]), np.frombuffer(text, np.uint8), k)
        rows = [(bucket, part, x[1], x[2], None, None) for x in shard.removals()]
        if not last:
            seg, spans = shard.left()
            rows += _dealt(seg, spans, text, np.full(len(seg), bucket), bucket + 1, part)
        return pa.concat_tables([done, pa.Table.from_batches([_packed(rows)]).select(done.column_names)])

    return run


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<int>"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int32()))])


def _result(ids: pa.Array, text: pa.Array, starts: list[list[bytes] | None], k: int) -> pa.RecordBatch:
    data, offsets = common.text_bytes(text)
    s, e, first = common.words(data, offsets, common.SPACED)
    raw = data.tobytes()
    n_words, n_removed, sha, removed = np.diff(first), [], [], []
    for i, found in enumerate(starts):
        a, b = first[i], first[i + 1]
        body = raw[offsets[i] : offsets[i + 1]]
        if not found:
            kept, gone = body.split(), []
        else:
            runs = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2)
            mark = np.zeros(b - a + 1, np.int32)
            np.add.at(mark, runs[:, 0], 1)
            np.add.at(mark, runs.sum(1) + k - 1, -1)
            out = np.cumsum(mark)[:-1] > 0
            gone = np.flatnonzero(out).tolist()
            stay = np.flatnonzero(~out) + a
            kept = [raw[x:y] for x, y in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]
        n_removed.append(len(gone))
        removed.append(gone)
        sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return common.batch(_RESULT_ARROW, ids, n_words.astype(np.int64), n_removed, sha, removed)


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256
    (of the kept words joined by a space), removed (numbers of the removed words)."""
    width = common.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets, bits = common.groups(docs, width, SHARD_BYTES), common.filter_log2(docs, 0.06)
    repeated = common.apply_arrow(_anchors(docs, window, anchor, buckets), "bucket", _repeated, "h long")
    wanted = common.bloom_of(repeated, ["h"], bits)
    if not len(wanted):
        wanted = common.Bloom.empty(bits).bits
    rows = _segments(docs, wanted, window, anchor, buckets)
    # Levels of shards by the number of tasks that the scan will have, roughly: with a level
    # too few or too many there are larger or more shards, and the same removals.
    tasks, level = common.task_count(docs), fan_in
    while tasks > fan_in:
        group = F.concat_ws("/", "bucket", (F.col("part") / level).cast("int"))
        rows = common.apply_arrow(rows.withColumn("grp", group), "grp", _meet(window, False), _ROWS_SQL)
        tasks, level = -(-tasks // fan_in), level * fan_in
    found = common.apply_arrow(rows, "bucket", _meet(window, True), "k binary, starts binary")
    removals = common.store(spark, found, "removals").withColumn("h", F.conv(F.hex(F.substring("k", 1, 7)), 16, 10).cast("long"))
    touched = common.bloom_of(removals.select("h").distinct(), ["h"], bits)
    if not len(touched):
        touched = common.Bloom.empty(bits).bits

    def split(batches):
        pick = common.Bloom(touched)
        for b in common.text_slices(batches):
            keys = common.doc_key(b.column(0), b.column(1))
            some = pick.has(np.array([int.from_bytes(x[:7], "big") for x in keys], U64))
            plain = pa.array(~some)
            done = _result(b.column(0).filter(plain), b.column(1).filter(plain), [None] * int((~some).sum()), window)
            yield _with_text(done, pa.nulls(done.num_rows, pa.binary()), pa.nulls(done.num_rows, pa.string()))
            open_ = pa.array(some)
            n = int(some.sum())
            if n:
                empty = pa.RecordBatch.from_arrays([b.column(0).filter(open_), *(pa.nulls(n, f.type) for f in list(_RESULT_ARROW)[1:])], schema=_RESULT_ARROW)
                yield _with_text(empty, pa.array([x for x, y in zip(keys, some, strict=True) if y], pa.binary()), b.column(1).filter(open_))

    def finish(batches):
        for b in batches:
            for part in common.text_slices([b]):
                yield _result(part.column(0), part.column(1), part.column(2).to_pylist(), window)

    parted = common.map_arrow(docs, split, f"{_RESULT}, k binary, text string")
    starts = removals.groupBy("k").agg(F.collect_list("starts").alias("starts"))
    # Two scans of the documents, so that finished rows need not be stored.
    joined = parted.where("k is not null").select("doc_id", "text", "k").join(starts, "k", "left").select("doc_id", "text", "starts")
    return parted.where("k is null").drop("k", "text").unionByName(common.map_arrow(joined, finish, _RESULT))


def _with_text(rows: pa.RecordBatch, k: pa.Array, text: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, k, text], names=[*rows.schema.names, "k", "text"])


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM g),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM o WHERE r > 1),
x AS (SELECT doc_id, list(i) AS gone FROM p GROUP BY doc_id),
kept AS (SELECT d.doc_id, d.w, gone, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE w[i] END), lambda y: y IS NOT NULL) AS k FROM d LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE k END, ' ')) AS kept_sha256 FROM kept
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole."""
    return substring_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
