"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give the bytes of every word a probability, each
byte from up to five before it in its word (the start of a word is a byte of its
own, and so is its end). Either model discounts its own counts; what it takes off
goes to a lower order that both share: continuation counts over all documents,
labelled or not. A context counts as if the shared order had been seen in it `STRENGTH`
times more, so that what a class has seen once or twice says little. Where neither class
has seen a context the shared counts cancel and the byte says nothing.

A word's evidence is the log-likelihood ratio of its bytes. A document's score is
a logistic function, fitted on sampled rows left out of the counts, of its
length-normalised ratio and of the same of its `STRONGEST` words: a few words
in a long text hardly move the first.

Class counts come from at most `SAMPLE_ROWS` labelled rows a class (a parameter) of at
most `SAMPLE_BYTES`, as many of either class, so that the ratio table is bounded and can
be broadcast, and no class knows more rare words only for being larger. The shared counts
cover all documents: every task sends each distinct sequence that it saw, once.

Defined results: null and empty texts have no evidence and get the score of none;
rows that repeat are scored each; a null doc_id is kept; without labels of both
classes every score is the labelled share; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.llm import common, learning
from causalframe.llm.common import U64

SAMPLE_ROWS = 6000
ORDER = 6
DISCOUNT = 0.75
STRENGTH = 10
#: Bytes of input for each group of contexts.
GROUP_BYTES = 5 << 19
#: Longer texts are not learnt from.
SAMPLE_BYTES = 64 << 10
CUTOFF = 0.7
#: How many of a document's strongest words make up the second feature.
STRONGEST = 3

_START, _END = 1, 2


def _word_bytes(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes, distinct words and each row's first word. Case does not count."""
    lowered = pc.utf8_lower(pc.fill_null(text, ""))
    data, offsets = common.text_bytes(lowered)
    s, e, first = common.words(data, offsets, common.ALNUM)
    codes, dictionary = common.word_codes(data, s, e)
    return codes, dictionary, first


def _sequences(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed sequence (last ORDER bytes, the start of the word at most) that ends
    at each byte of each word and at its end; and which word."""
    data, offsets = common.text_bytes(dictionary)
    n = np.diff(offsets)
    # Every word as: start, bytes, end.
    size = n + 2
    at = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint8)
    inside = np.ones(len(flat), bool)
    inside[at], inside[at + n + 1] = False, False
    flat[at], flat[at + n + 1] = _START, _END
    flat[inside] = data
    place = np.arange(len(flat)) - np.repeat(at, size)
    keys = flat.astype(U64)
    for back in range(1, ORDER):
        prev = np.zeros(len(flat), U64)
        prev[back:] = flat[:-back].astype(U64)
        keys |= np.where(place >= back, prev << U64(8 * back), U64(0))
    keep = place > 0
    return keys[keep], np.repeat(np.arange(len(n)), n + 1)


def _shorter(context: np.ndarray) -> np.ndarray:
    """A context without its first byte."""
    out = context
    for k in range(8):
        top = context >> U64(8 * k)
        first = (top != 0) & (top <= U64(0xFF))
        out = np.where(first, context & ((U64(1) << U64(8 * k)) - U64(1)), out)
    return out


def _partial(batches, buckets: int):
    """For each bucket of shortened contexts, this task's sequences: distinct ones of all
    documents, and those of labelled ones with counts of either class."""
    every = np.zeros(0, U64)
    waiting: list[np.ndarray] = []
    counts: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (every, np.zeros(0, np.int64)), 1: (every, np.zeros(0, np.int64))}
    for b in common.text_slices(batches):
        codes, dictionary, first = _word_bytes(b.column(1))
        keys, word = _sequences(dictionary)
        waiting.append(np.unique(keys))
        if sum(map(len, waiting)) > 2_000_000:
            every = np.unique(np.concatenate([every, *waiting]))
            waiting = []
        label = np.where(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False) <= SAMPLE_BYTES, pc.fill_null(b.column(2), -1).to_numpy(zero_copy_only=False), -1)
        fold = pc.fill_null(b.column(3), 0).to_numpy(zero_copy_only=False)
        of = label[common.row_of(first)]
        of = np.where(fold[common.row_of(first)] == 0, -1, of)
        for k in (0, 1):
            n = np.bincount(codes[of == k], minlength=len(dictionary))[word]
            used = n > 0
            keys_k, at = np.unique(np.concatenate([counts[k][0], keys[used]]), return_inverse=True)
            counts[k] = keys_k, np.bincount(at.ravel(), np.concatenate([counts[k][1], n[used]]), len(keys_k)).astype(np.int64)
    every = np.unique(np.concatenate([every, *waiting]))

    def dealt(keys: np.ndarray) -> np.ndarray:
        return (common.mix(_shorter(keys >> U64(8))) % U64(buckets)).astype(np.int64)

    rows = []
    for kind, keys, n in ((2, every, None), (0, *counts[0]), (1, *counts[1])):
        home = dealt(keys)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(buckets + 1))
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                rows.append((k, kind, keys[own].tobytes(), b"" if n is None else n[own].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "kind", "keys", "n"])


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at.ravel(), n, len(distinct))


def _at(table: np.ndarray, keys: np.ndarray, values: np.ndarray, otherwise: float = 0.0) -> np.ndarray:
    """values[table == keys], elsewhere otherwise."""
    if not len(table):
        return np.full(len(keys), otherwise)
    i = np.searchsorted(table, keys).clip(max=len(table) - 1)
    return np.where(table[i] == keys, values[i], otherwise)


def _ratios(key, table):
    """The log ratios of a bucket's sequences (kind 0), and of its contexts where a byte
    that neither class has seen there follows (kind 1)."""
    kinds = table.column("kind").to_pylist()
    blobs, counts = table.column("keys").to_pylist(), table.column("n").to_pylist()

    def joined(kind: int, source: list, dtype) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype) for k, x in zip(kinds, source, strict=True) if k == kind)])

    every = np.unique(joined(2, blobs, U64))
    byte, context = every & U64(0xFF), _shorter(every >> U64(8))
    # Continuations: how many different bytes stand before (context, byte).
    pair, before = _sums(context << U64(8) | byte, np.ones(len(every)))
    home, total = _sums(pair >> U64(8), before)
    _, follow = _sums(pair >> U64(8), np.ones(len(pair)))
    log_sum = {}
    seen = [_sums(joined(k, blobs, U64), joined(k, counts, np.int64)) for k in (0, 1)]
    keys = np.union1d(seen[0][0], seen[1][0])
    contexts = np.unique(keys >> U64(8))
    short = _shorter(keys >> U64(8))
    n_pair = _at(pair, short << U64(8) | (keys & U64(0xFF)), before)
    n_home, n_follow = _at(home, short, total, 1.0), _at(home, short, follow, 1.0)
    shared = (np.maximum(n_pair - DISCOUNT, 0) + DISCOUNT * n_follow / 256) / n_home
    for k in (0, 1):
        own, n = seen[k]
        ctx, ctx_n = _sums(own >> U64(8), n)
        _, ctx_t = _sums(own >> U64(8), np.ones(len(own)))
        c, t = _at(ctx, keys >> U64(8), ctx_n), _at(ctx, keys >> U64(8), ctx_t)
        p = (np.maximum(_at(own, keys, n) - DISCOUNT, 0) + (STRENGTH + DISCOUNT * t) * shared) / (STRENGTH + c)
        c, t = _at(ctx, contexts, ctx_n), _at(ctx, contexts, ctx_t)
        log_sum[k] = np.log(p), np.log((STRENGTH + DISCOUNT * t) / (STRENGTH + c))
    pairs, alone = log_sum[1][0] - log_sum[0][0], log_sum[1][1] - log_sum[0][1]
    return pa.table({"kind": pa.array([0, 1], pa.int32()), "keys": pa.array([keys.tobytes(), contexts.tobytes()], pa.binary()), "value": pa.array([pairs.astype(np.float32).tobytes(), alone.astype(np.float32).tobytes()], pa.binary())})


class Ratios:
    """The table of log ratios: sequences, then contexts."""

    def __init__(self, rows: list):
        self.parts = []
        for kind in (0, 1):
            keys = np.concatenate([np.zeros(0, U64), *(np.frombuffer(r["keys"], U64) for r in rows if r["kind"] == kind)])
            value = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["value"], np.float32) for r in rows if r["kind"] == kind)])
            order = np.argsort(keys)
            self.parts.append((keys[order], value[order]))

    def words(self, dictionary: pa.Array) -> np.ndarray:
        """The log ratio of each distinct word."""
        keys, word = _sequences(dictionary)
        distinct, at = np.unique(keys, return_inverse=True)
        found = _at(self.parts[0][0], distinct, self.parts[0][1], np.nan)
        rest = _at(self.parts[1][0], distinct >> U64(8), self.parts[1][1])
        value = np.where(np.isnan(found), rest, found)
        return np.bincount(word, value[at.ravel()], len(dictionary))

    def features(self, text: pa.Array) -> np.ndarray:
        """Each row's mean ratio by word and the mean of its strongest words."""
        codes, dictionary, first = _word_bytes(text)
        value = self.words(dictionary)[codes]
        n = np.diff(first)
        sums = np.concatenate([[0.0], np.cumsum(value)])
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        row = common.row_of(first)
        order = np.lexsort((-value, row))
        rank = np.arange(len(value)) - np.repeat(first[:-1], n)
        top = rank < STRONGEST
        strong = np.bincount(row[top], value[order][top], len(n)) / STRONGEST
        return np.column_stack([mean, strong])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, parts: int, held: int, sample_rows: int = SAMPLE_ROWS) -> tuple[Ratios, tuple]:
    """The ratio table and the calibration."""
    width = common.tune(spark)
    sample = common.store(spark, learning.labelled_sample(labels, "toxic", parts, held, sample_rows), "sample")
    buckets = common.groups(docs, width, GROUP_BYTES)
    rows = common.map_arrow(learning.marked(docs, sample), lambda b: _partial(b, buckets), "bucket int, kind int, keys binary, n binary")
    ratios = Ratios(common.apply_arrow(rows, "bucket", _ratios, "kind int, keys binary, value binary").collect())

    def calibrate(batches):
        for b in common.text_slices(batches):
            x = ratios.features(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column(2).cast(pa.int32())], names=["a", "b", "y"])

    kept = learning.marked(docs, sample).where("fold = 0")
    seen = np.array([tuple(r) for r in common.map_arrow(kept, calibrate, "a double, b double, y int").collect()]).reshape(-1, 3)
    return ratios, learning.fit_logistic(seen[:, :2], seen[:, 2])


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted,
    log_ratio (by word). labels: (doc_id, toxic); rows whose crc32(doc_id) mod parts is
    `held` are never learnt from."""
    ratios, calibration = fit(spark, docs, labels, parts, held, sample_rows)

    def run(batches):
        for b in common.text_slices(batches):
            x = ratios.features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(learning.logistic(calibration, x)), pa.array(x[:, 0])], names=["doc_id", "score", "log_ratio"])

    scored = common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, log_ratio double")
    return scored.select("doc_id", (learning.remainder(parts) == held).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "log_ratio")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return toxicity(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
