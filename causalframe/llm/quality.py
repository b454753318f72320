"""Quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are its own (shares
of kinds of characters, word lengths, repetition) and those of the lines beside it;
the chain's weights tie neighbouring labels. Forward-backward gives each line's
marginal; their mean by length, as probabilities and as log odds, is the document's
quality, which a logistic function, fitted on sampled rows that the field was not,
turns into the score.

The field learns from at most `SAMPLE_ROWS` labelled documents a class, of at most
`SAMPLE_LINES` lines (parameters); a document's label is that of all its lines.

Defined results: null and empty texts are one empty line; rows that repeat are
scored each; a null doc_id is kept; without labels of both classes every score is
the labelled share; extra columns are ignored; lines have no largest length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.llm import common, learning

SAMPLE_ROWS = 3000
#: Texts of more lines are not learnt from.
SAMPLE_LINES = 128
CUTOFF = 0.7
STEPS = 150


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[[ord(c) for c in chars]] = 1
    return table


_KINDS = np.stack([
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _table("abcdefghijklmnopqrstuvwxyz"),
    _table("0123456789"),
    _table(".,;:'\"?()-"),
    _table("!"),
    _table("#$%&*@^~=+_"),
    _table("|/\\<>[]{}`"),
    _table(" \t\r"),
    np.r_[np.zeros(128, np.float32), np.ones(128, np.float32)],
])
OWN = len(_KINDS) + 7


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (own, the line before, the line after), its bytes, and each
    row's first line (one more than rows)."""
    data, offsets = common.text_bytes(column)
    rows = len(offsets) - 1
    # A line ends at a line feed or at the end of its text; a text has one line at least.
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    owner = np.searchsorted(offsets[1:], feeds, side="right")
    counts = 1 + np.bincount(owner, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:]
    ends[-1] = len(data)
    is_last = np.zeros(len(starts), bool)
    is_last[first[1:] - 1] = True
    ends = np.where(is_last, np.repeat(offsets[1:], counts), ends - 1)
    size = np.maximum(ends - starts, 0)

    x = np.zeros((len(starts), OWN), np.float32)
    for k, table in enumerate(_KINDS):
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.float64)])
        x[:, k] = (sums[ends.clip(min=starts)] - sums[starts]) / np.maximum(size, 1)
    k = len(_KINDS)
    s, e, _ = common.words(data, offsets, common.SPACED)
    codes, dictionary = common.word_codes(data, s, e)
    # Words never hold a line feed, so a word's line is that of its first byte.
    line = np.searchsorted(starts, s, side="right") - 1
    n = np.bincount(line, minlength=len(starts))
    per = np.maximum(n, 1)
    x[:, k] = np.log1p(size)
    x[:, k + 1] = np.bincount(line, e - s, len(starts)) / per
    x[:, k + 2] = np.bincount(line, (e - s) > 24, len(starts)) / per
    distinct = np.unique(line.astype(np.int64) << 32 | codes) >> 32
    x[:, k + 3] = np.bincount(distinct, minlength=len(starts)) / per
    h = common.hash_bytes(dictionary)[codes] if len(codes) else np.zeros(0, np.uint64)
    gram = common.gram_hash(h, 4)
    same = line[: len(gram)] == line[3:] if len(gram) else np.zeros(0, bool)
    row = np.searchsorted(first, line[: len(gram)], side="right") - 1
    # Four-word sequences by text: the share of a line's that are not the text's first.
    key = common.mix(gram ^ common.mix(row.astype(np.uint64) + common.K1))
    _, at = np.unique(key, return_index=True)
    new = np.zeros(len(gram), bool)
    new[at] = True
    grams = np.bincount(line[: len(gram)][same], minlength=len(starts))
    x[:, k + 4] = np.bincount(line[: len(gram)][same & ~new], minlength=len(starts)) / np.maximum(grams, 1)
    x[:, k + 5] = np.bincount(line, _upper_words(data, s, e), len(starts)) / per
    x[:, k + 6] = size == 0

    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return np.hstack([x, before, after]), size, first


def _upper_words(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Words without lower-case letters a-z and with upper-case ones."""
    low = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    up = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    return (low[e] == low[s]) & (up[e] - up[s] > 1)


class Chains:
    """Chains of several lengths side by side, longest first, so that step t works on
    the first live[t] of them."""

    def __init__(self, first: np.ndarray):
        n = np.diff(first)
        self.order = np.argsort(-n, kind="stable")
        sizes = n[self.order]
        self.steps = int(sizes[0]) if len(sizes) else 0
        self.live = np.searchsorted(-sizes, -np.arange(1, self.steps + 1), side="right")
        self.head, self.sizes = first[:-1][self.order], sizes

    def marginals(self, score: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of every line, expected transitions, and the sum of log partitions.
        score: of a line being good; chain: 2 x 2, from bad/good to bad/good."""
        alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        potential = np.column_stack([np.zeros(len(score)), score])
        for t in range(self.steps):
            at = self.head[: self.live[t]] + t
            alpha[at] = potential[at]
            if t:
                alpha[at] += np.logaddexp(alpha[at - 1][:, :1] + chain[0], alpha[at - 1][:, 1:] + chain[1])
        last = self.head + self.sizes - 1
        log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
        moves = np.zeros((2, 2))
        for t in range(self.steps - 1, 0, -1):
            at = self.head[: self.live[t]] + t
            onward = potential[at] + beta[at]
            beta[at - 1] = np.logaddexp(chain[:, 0] + onward[:, :1], chain[:, 1] + onward[:, 1:])
            joint = alpha[at - 1][:, :, None] + chain + onward[:, None, :] - log_z[: len(at), None, None]
            moves += np.exp(joint).sum(0)
        z = np.empty(len(score))
        z[np.concatenate([np.arange(h, h + n) for h, n in zip(self.head, self.sizes, strict=True)])] = np.repeat(log_z, self.sizes)
        return np.exp(alpha[:, 1] + beta[:, 1] - z), moves, float(log_z.sum())


class Field:
    """The fitted field: scaling, weights of a good line, chain weights."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, chain: np.ndarray):
        self.mean, self.scale, self.w, self.chain = mean, scale, w, chain

    @staticmethod
    def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
        """Gradient steps (Adam) on the mean log-likelihood of the chains, classes balanced."""
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        chains, n = Chains(first), np.diff(first)
        y = np.repeat(label, n).astype(float)
        w, chain = np.zeros(z.shape[1]), np.zeros((2, 2))
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = (n[label == k] - 1).sum()
        for t in range(1, steps + 1):
            p, moves, _ = chains.marginals(z @ w, chain)
            grad = np.concatenate([z.T @ (y - p) / len(label) - 1e-3 * w, ((seen - moves) / len(label) - 1e-2 * chain).ravel()])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, chain = w + step[: len(w)], chain + step[len(w) :].reshape(2, 2)
        return Field(mean, scale, w, chain)

    def documents(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's features for the calibration (mean marginal and mean log odds of its
        lines, by length), and every line's marginal."""
        score = ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]
        p, _, _ = Chains(first).marginals(score, self.chain)
        weight = size + 1.0
        row = common.row_of(first)
        total = np.bincount(row, weight, len(first) - 1)
        quality = np.bincount(row, weight * p, len(first) - 1) / total
        sure = p.clip(1e-9, 1 - 1e-9)
        odds = np.bincount(row, weight * (np.log(sure) - np.log1p(-sure)), len(first) - 1) / total
        return np.column_stack([quality, odds]), p


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, parts: int, held: int, sample_rows: int = SAMPLE_ROWS) -> tuple[Field | None, tuple]:
    """The field and its calibration."""
    common.tune(spark)
    sample = common.store(spark, learning.labelled_sample(labels, "quality", parts, held, sample_rows), "sample")

    def features(batches):
        for b in common.text_slices(batches):
            x, size, first = line_features(b.column(1))
            cut = [(x[a:z].astype(np.float32).tobytes(), size[a:z].astype(np.int64).tobytes()) if z - a <= SAMPLE_LINES else (None, None) for a, z in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary()), b.column(2).cast(pa.int32()), b.column(3).cast(pa.int32())], names=["x", "size", "label", "fold"])

    rows = common.map_arrow(learning.marked(docs, sample).where("label is not null"), features, "x binary, size binary, label int, fold int").where("x is not null").collect()

    def stacked(own: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = [np.frombuffer(r["size"], np.int64) for r in own]
        x = np.concatenate([np.frombuffer(r["x"], np.float32) for r in own]).reshape(-1, 3 * OWN).astype(float)
        return x, np.concatenate(size), np.concatenate([[0], np.cumsum([len(s) for s in size])]), np.array([r["label"] for r in own])

    learnt, kept = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]]
    if len({r["label"] for r in learnt}) < 2 or len({r["label"] for r in kept}) < 2:
        return None, learning.fit_logistic(np.zeros((len(rows), 2)), np.array([r["label"] for r in rows], float) if rows else np.zeros(0))
    x, _, first, label = stacked(learnt)
    field = Field.fit(x, first, label)
    x, size, first, label = stacked(kept)
    return field, learning.fit_logistic(field.documents(x, size, first)[0], label.astype(float))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted,
    bad_lines (numbers from 0). labels: (doc_id, quality); rows whose crc32(doc_id) mod
    parts is `held` are never learnt from. Other columns of docs follow unchanged."""
    field, calibration = fit(spark, docs, labels, parts, held, sample_rows)
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text", "score", "bad_lines")]

    def run(batches):
        for b in common.text_slices(batches):
            bad = [[] for _ in range(b.num_rows)]
            if field is None:
                x = np.zeros((b.num_rows, 2))
            else:
                lines, size, first = line_features(b.column(1))
                x, p = field.documents(lines, size, first)
                for k in np.flatnonzero(p < 0.5):
                    d = int(np.searchsorted(first, k, side="right")) - 1
                    bad[d].append(int(k - first[d]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[2:], pa.array(learning.logistic(calibration, x)), pa.array(bad, pa.list_(pa.int32()))], names=[*b.schema.names, "score", "bad_lines"])

    schema = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{f.name}`") for f in others))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    scored = common.map_arrow(schema, run, f"{kinds}, score double, bad_lines array<int>")
    return scored.withColumns({"held_out": learning.remainder(parts) == held, "predicted": (F.col("score") >= cutoff).cast("int")})


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    found = quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted")
