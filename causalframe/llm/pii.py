"""Personal data by patterns and a skip-chain conditional random field.

The base patterns (email, ip, card, phone) are reported as they match. Around them
a field over the tokens that hold a digit or an @ labels each token with one of the
four kinds or none. Its edges tie neighbouring tokens, and distant tokens of one text
that are equal or end in the same digits (skip edges), so a number that is plainly a
phone number in one place pulls its bare repetition elsewhere along. Marginals come
from loopy belief propagation on each text's whole graph; runs of tokens with a sure
label that the patterns did not report are added.

Weights are learnt by pseudo-likelihood from what the patterns label in at most
`SAMPLE_ROWS` texts of `SAMPLE_CHARS` characters and `SAMPLE_TOKENS` tokens in all
(parameters): those with the smallest hashes of their content. So that the skip edges learn to carry a label,
every such text is also learnt with its findings mentioned once more without their
leading part, as what they are, and with look-alikes of other digits, as none; and
some tied tokens' own features are left out.

Defined results: null text is empty and has no spans; rows that repeat are scanned
each; a null doc_id is kept; extra columns are ignored; texts have no largest length.
A token is tied to the one before it that is equal and to the one before it that ends
in the same digits, and to the first of each group that a pattern's match covers, so edges
grow with the text, not with its square, and every mention is next to a sure one. What a
pattern matched is given, not judged. Messages are passed on until they settle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.llm import common
from causalframe.llm.scan_rows import Span, scan

BASE = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 1500
#: Longer texts are not learnt from.
SAMPLE_CHARS = 20_000
#: Tokens to learn from at most; texts with more than a twentieth of them are left out of learning.
SAMPLE_TOKENS = 60_000
SURE = 0.9
#: Messages have settled when none changes by more; a loop that never does stops after ROUNDS.
SETTLED = 1e-8
ROUNDS = 1000
#: Digits at the end that make two tokens alike.
ALIKE_DIGITS = 7

HINTS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9]([ -]?[0-9]){13}",
    "phone": r"\+[0-9]",
}

#: Texts worth a search: those with a token of the field. A pattern's match is one, too.
NODE = {"node": "[0-9@]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str, hint: dict[str, bool]) -> list[Span]:
    """Leftmost matches that do not overlap within a kind, in time linear in the text.
    An email holds one @, so each @ is tried with what stands before it since the last match."""
    spans: list[Span] = []
    if hint["email"]:
        last, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                spans.append(("email", start, m.end()))
                last = m.end()
            else:
                # What stands before an @ cannot reach over it.
                last = at + 1
            at = text.find("@", max(last, at + 1))
    if hint["ip"]:
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if hint["card"]:
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
    if hint["phone"]:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return spans


# ------------------------------------------------------------------- the graph
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_EDGE = ".,;:!?\"'*#$%&|<>[]{}"
OWN = 22
#: A token's own features and those of its neighbours.
FEATURES = 3 * OWN


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens that hold a digit or an @, without punctuation at their ends."""
    found = []
    for m in _TOKEN.finditer(text):
        body = m[0]
        if not _MARK.search(body):
            continue
        a = len(body) - len(body.lstrip(_EDGE))
        b = len(body.rstrip(_EDGE))
        if b > a:
            found.append((m.start() + a, m.start() + b))
    return found


def _own_features(text: str, s: int, e: int) -> list[float]:
    t = text[s:e]
    d = _digits(t)
    n = len(d)
    letters = sum(c.isalpha() for c in t)
    parts = t.split(".")
    return [
        1.0, "@" in t, t.count("@") == 1 and "." in t.partition("@")[2], letters > 0, letters > n,
        t[0] == "+", t[0] == "(" and t[-1] == ")", "-" in t, n == 1, 2 <= n <= 3,
        n == 4, 5 <= n <= 6, n == 7, 8 <= n <= 9, 10 <= n <= 13,
        14 <= n <= 19, n >= 20, len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts), 14 <= n <= 19 and luhn(d), letters == 0 and n == 4 and len(t) == 4,
        "/" in t or ":" in t, len(t) > 30,
    ]


class Graph:
    """Tokens of some texts: own features, chain edges (at most one character between
    two tokens), skip edges."""

    def __init__(self, texts: list[str], base: list[list[Span]] | None = None):
        """base: what patterns matched in each text; `given` has the labels of its tokens."""
        feats, chain, self.spans = [], [], []
        groups: list[list[int]] = []
        for row, text in enumerate(texts):
            equal: dict[str, list[int]] = {}
            alike: dict[str, list[int]] = {}
            end = -9
            for s, e in tokens(text):
                k, t = len(self.spans), text[s:e]
                self.spans.append((row, s, e))
                feats.append(_own_features(text, s, e))
                if s - end <= 1:
                    chain.append((k - 1, k))
                end = e
                equal.setdefault(t.lower(), []).append(k)
                d = _digits(t)
                if len(d) >= ALIKE_DIGITS:
                    alike.setdefault(d[-ALIKE_DIGITS:], []).append(k)
            groups += [g for g in (*equal.values(), *alike.values()) if len(g) > 1]
        self.given = _labels(self, base) if base is not None else np.zeros(len(self.spans), int)
        skip = set()
        for g in groups:
            hub = next((k for k in g if self.given[k]), None)
            skip.update(zip(g, g[1:], strict=False))
            # A hub that is itself open would only gather what its own group guesses.
            skip.update((min(k, hub), max(k, hub)) for k in g if hub not in (None, k))
        skip = sorted(skip)
        self.chain, self.skip = (np.array(p, int).reshape(-1, 2) for p in (chain, skip))
        own = np.array(feats, float).reshape(-1, OWN)
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[self.chain[:, 1]], after[self.chain[:, 0]] = own[self.chain[:, 0]], own[self.chain[:, 1]]
        self.x = np.hstack([own, before, after])


LABELS = 1 + len(BASE)
#: Score of the labels that a given token does not have.
NEVER = -1e9


class Field:
    """Weights: own features by label, chain edges, skip edges (both label by label)."""

    def __init__(self, own: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.own, self.chain, self.skip = own, chain, skip

    @staticmethod
    def fit(graph: Graph, y: np.ndarray, steps: int = 400, hidden: float = 0.3) -> Field:
        """Adam, piece by piece: first every token given its features alone, then given its
        neighbours' labels as well, with the edges' weights free and the features' fixed."""
        rng = np.random.default_rng(7)
        n = len(y)
        weights = [np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        one = np.eye(LABELS)[y] if n else np.zeros((0, LABELS))
        tied = np.zeros(n, bool)
        tied[graph.skip.ravel()] = True

        def around(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Neighbours' labels, counted: those before and those after a token."""
            left, right = np.zeros((n, LABELS)), np.zeros((n, LABELS))
            np.add.at(left, edges[:, 1], one[edges[:, 0]])
            np.add.at(right, edges[:, 0], one[edges[:, 1]])
            return left, right

        (cl, cr), (sl, sr) = around(graph.chain), around(graph.skip)
        rare = np.maximum(np.bincount(y, minlength=LABELS), 1)
        share = np.sqrt(n / LABELS / rare)[y] if n else np.zeros(0)
        for step in range(2 * steps):
            t, edges = step % steps + 1, step >= steps
            x = graph.x * ~(edges & tied & (rng.random(n) < hidden))[:, None]
            score = x @ weights[0] + cl @ weights[1] + cr @ weights[1].T + sl @ weights[2] + sr @ weights[2].T
            p = np.exp(score - score.max(1, keepdims=True)) if n else score
            p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
            r = (one - p) * share[:, None] / max(n, 1)
            grads = [x.T @ r, cl.T @ r + r.T @ cr, sl.T @ r + r.T @ sr]
            for k in (1, 2) if edges else (0,):
                g = grads[k] - 1e-4 * weights[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                weights[k] += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return Field(*weights)

    def marginals(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy belief propagation: messages along both ways of every edge, damped by half,
        until they settle."""
        own = graph.x @ self.own
        known = np.flatnonzero(graph.given)
        own[known] = NEVER
        own[known, graph.given[known]] = 0.0
        edges = np.concatenate([graph.chain, graph.skip])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        m, n = len(graph.chain), len(edges)
        ways = [(slice(0, m), self.chain), (slice(m, n), self.skip), (slice(n, n + m), self.chain.T), (slice(n + m, 2 * n), self.skip.T)]
        ways = [(at, np.exp(t - t.max())) for at, t in ways]
        message = np.zeros((len(source), LABELS))

        def beliefs() -> np.ndarray:
            return own + np.stack([np.bincount(target, message[:, s], len(own)) for s in range(LABELS)], 1)

        for _ in range(rounds if len(source) else 0):
            cavity = beliefs()[source] - message[back]
            top = cavity.max(1, keepdims=True)
            share = np.exp(cavity - top)
            new = np.empty_like(message)
            for at, table in ways:
                new[at] = np.log(share[at] @ table)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            new = 0.5 * (message + new)
            moved = np.abs(new - message).max()
            message = new
            if moved < SETTLED:
                break
        total = beliefs()
        return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True)) if len(total) else total

    def hopeless(self, graph: Graph) -> bool:
        """Whether no token can become sure, whatever its edges say: a message tells a label
        from none by at most the largest difference in its edge's table."""
        score = graph.x @ self.own
        reach = score[:, 1:] - score[:, :1]
        for edges, table in ((graph.chain, self.chain), (graph.skip, self.skip)):
            for end, t in ((1, table), (0, table.T)):
                most = np.maximum((t[:, 1:] - t[:, :1]).max(0), 0)
                reach = reach + np.bincount(edges[:, end], minlength=len(reach))[:, None] * most
        return not (reach[graph.given == 0] >= np.log(SURE / (1 - SURE)) - 1e-6).any()


def _labels(graph: Graph, spans: list[list[Span]]) -> np.ndarray:
    """The kind of the base span that covers most of a token; 0 without one."""
    y = np.zeros(len(graph.spans), int)
    now, todo, near = -1, [], []
    for k, (row, s, e) in enumerate(graph.spans):
        if row != now:
            now, todo, near = row, sorted(spans[row], key=lambda x: -x[1]), []
        # Tokens come in order: spans that ended before one are done.
        while todo and todo[-1][1] < e:
            near.append(todo.pop())
        near = [x for x in near if x[2] > s]
        for kind, a, b in near:
            if min(e, b) - max(s, a) > (e - s) / 2:
                y[k] = 1 + BASE.index(kind)
    return y


def _plausible(kind: str, text: str) -> bool:
    n = len(_digits(text))
    return {"email": "@" in text, "ip": text.count(".") == 3, "card": 14 <= n <= 19, "phone": 7 <= n <= 15}[kind]


def added_spans(text: str, graph: Graph, at: range, p: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of neighbouring tokens with one sure kind that no base span touches."""
    out, run = [], None
    starts = sorted((a, b) for _, a, b in base)
    furthest = list(accumulate((b for _, b in starts), max))

    def touched(s: int, e: int) -> bool:
        before = bisect_left(starts, (e, 0))
        return before > 0 and furthest[before - 1] > s

    for k in [*at, None]:
        label = int(p[k].argmax()) if k is not None else 0
        sure = k is not None and label > 0 and p[k, label] >= SURE
        if sure:
            _, s, e = graph.spans[k]
            sure = not touched(s, e)
        if run and (not sure or run[0] != label or graph.spans[k][1] - run[2] > 1):
            if _plausible(BASE[run[0] - 1], text[run[1] : run[2]]):
                out.append((BASE[run[0] - 1], run[1], run[2]))
            run = None
        if sure:
            run = (label, run[1] if run else s, e)
    return out


def mentions(texts: list[str], seed: int = 5) -> tuple[list[str], list[list[Span]]]:
    """Texts to learn from and their spans: each as it is, and with its findings
    mentioned again without their first token or sign, next to look-alikes."""
    rng = np.random.default_rng(seed)
    out, spans = [], []
    for text in texts:
        base = base_spans(text, dict.fromkeys(HINTS, True))
        out.append(text)
        spans.append(base)
        if base:
            more, size, own = [text], len(text), list(base)
            for kind, s, e in base:
                bare = text[s:e].lstrip("+").split(" ", 1)[-1] if kind != "card" else text[s:e]
                other = "".join(str(rng.integers(10)) if c.isdigit() else c for c in bare)
                gap = f"\n \n{other} and \n \n" if kind in ("phone", "card") else "\n \n"
                more += [gap, bare]
                own.append((kind, size + len(gap), size + len(gap) + len(bare)))
                size += len(gap) + len(bare)
            out.append("".join(more))
            spans.append(own)
    return out, spans


def fit(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """The field of a bounded sample of texts that patterns hint at. Tasks first send how
    many different ones there are; that tells the hash below which about sample_rows of them
    lie, and only those are sent."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def candidates(below: int | None):
        import xxhash

        def run(batches):
            for b in common.text_slices(batches):
                texts = pc.fill_null(b.column(1), "")
                some = None
                for p in HINTS.values():
                    m = pc.match_substring_regex(texts, p)
                    some = m if some is None else pc.or_(some, m)
                found = [(xxhash.xxh3_64_intdigest(t.encode()) >> 1, t) for t in texts.filter(some).to_pylist() if len(t) <= SAMPLE_CHARS]
                if below is not None:
                    found = [x for x in found if x[0] < below]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([None if below is None else t for _, t in found], pa.string())], names=["h", "text"])

        return common.map_arrow(docs, run, "h long, text string")

    n = candidates(None).agg(F.approx_count_distinct("h", 0.02)).first()[0]
    # A fifth more than wanted, since the count is not exact.
    below = min(2**63 - 1, int(2**63 * 1.2 * (sample_rows + 50) / max(n, 1)))
    found = candidates(below).groupBy("h").agg(F.min("text").alias("text"))
    texts = [r["text"] for r in found.orderBy("h").limit(sample_rows).collect()]
    sizes = [len(tokens(t)) for t in texts]
    fit_in = [t for t, n in zip(texts, sizes, strict=True) if n <= SAMPLE_TOKENS // 20]
    left = accumulate(n for n in sizes if n <= SAMPLE_TOKENS // 20)
    texts, spans = mentions([t for t, n in zip(fit_in, left, strict=True) if n <= SAMPLE_TOKENS])
    graph = Graph(texts, spans)
    return Field.fit(graph, _labels(graph, spans))


def pii_scan(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans (text), n_spans, found (kind, start, end, value). Offsets are code points."""
    common.tune(spark)
    field = fit(spark, docs, sample_rows)

    def find(text: str, hint: dict[str, bool]) -> tuple[list[Span], list[Span]]:
        base = base_spans(text, hint)
        graph = Graph([text], [base])
        if field.hopeless(graph):
            return base, []
        return base, added_spans(text, graph, range(len(graph.spans)), field.marginals(graph), base)

    return scan(docs, find, BASE, (), HINTS | NODE)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return pii_scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
