"""Scanners against plain patterns, classifiers by held-out accuracy, the pipeline's stages."""

import base64
import json
import os
import re
import zlib

import numpy as np
import pytest

from causalframe.llm import pii, quality, scan_rows, secrets, toxicity, url_filter

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
SCHEMA = "doc_id long, text string, score double, spans string, label int"


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | len(x := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + x) + body


def jwt(header):
    def enc(x):
        return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")

    return f"{enc(header)}.{enc({'sub': '1234567890'})}.c2lnbmF0dXJl"


RSA = der(0x30, b"".join(der(0x02, x) for x in (b"\0", b"\x7f" * 65, b"\x01\0\x01", b"\x55" * 64, b"\x33" * 33, b"\x31" * 33, b"\x2f" * 33, b"\x21" * 33, b"\x11" * 33)))


def fields(*parts):
    return b"".join(len(x).to_bytes(4, "big") + x for x in parts)


SSH_PUBLIC = fields(b"ssh-ed25519", b"\x07" * 32)
_PRIVATE = b"\x21\x43\x65\x07" * 2 + fields(b"ssh-ed25519", b"\x07" * 32, b"\x09" * 64, b"me@home")


def openssh(cipher=b"none", kdf=b"none", options=b"", n=1, public=SSH_PUBLIC, private=_PRIVATE + bytes(range(1, 1 + -len(_PRIVATE) % 8))):
    return b"openssh-key-v1\0" + fields(cipher, kdf, options) + n.to_bytes(4, "big") + fields(public, private)


SSH = openssh()
_AES = der(0x30, der(0x06, bytes.fromhex("2a864886f70d01050d")) + der(0x30, b""))
ENCRYPTED = der(0x30, _AES + der(0x04, b"\x5a" * 64))
EC = der(0x30, der(0x02, b"\x01") + der(0x04, b"\x42" * 16) + der(0xA0, b""))
ED25519 = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2b\x65\x70")) + der(0x04, der(0x04, b"\x11" * 32)))


def secret_base(t):
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    out = [("assign", *m.span()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return scan_rows.ordered(out, secrets.BASE)


SECRET_TEXTS = [
    "secret=token : abcdefg", "Token = 'abc123def' AKIA" + "A" * 15, "x AKIA" + "B7" * 8 + " y", "é" * 9 + " " + "0f" * 13 + "G", "paſſword=abcdefgh tokeN:\"abcdef\"",
    "api_key : " + "k" * 50, jwt({"alg": "HS256"}), jwt({"typ": "JWT"}), base64.b64encode(RSA).decode(), RSA.hex(), base64.b64encode(SSH).decode(), base64.b64encode(RSA[:-1]).decode(),
    f"-----BEGIN RSA PRIVATE KEY-----\n{base64.b64encode(RSA).decode()}\n-----END RSA PRIVATE KEY-----", "a" * 3000, "", None,
]


def test_secrets(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(SECRET_TEXTS)] + [(None, SECRET_TEXTS[0], None, None, None)] * 2
    found = secrets.secret_scan(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = SECRET_TEXTS[r.doc_id or 0] or ""
        base = secret_base(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == b for k, _, _ in base) for b in secrets.BASE)
        import hashlib

        assert r.base_sha256 == hashlib.sha256(scan_rows.digest(base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
        assert all(text[x.start : x.end] == x.value for x in r.found) and r.n_spans == len(r.found)
    kinds = {r.doc_id: {x.kind for x in r.found} - set(secrets.BASE) for r in found if r.doc_id is not None}
    assert [kinds[i] for i in range(6, 13)] == [{"signed_token"}, set(), {"der_key"}, {"der_key"}, {"ssh_key"}, set(), {"armoured_key", "der_key"}]
    assert secrets.secret_scan(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def pii_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a@@.b%é-1 2+", "0123456789 -.+()x", "١२1.25@a "])
def test_pii_patterns_are_leftmost(alphabet):
    rng = np.random.default_rng(3)
    hint = dict.fromkeys(pii.HINTS, True)
    for _ in range(8000):
        t = "".join(rng.choice(list(alphabet), rng.integers(1, 45)))
        assert sorted(pii.base_spans(t, hint)) == pii_base(t)


def test_pii_skip_edges(spark):
    rng = np.random.default_rng(5)

    def number():
        return f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"

    rows = [(i, f"ab +1 {number()} cd e.{i}@mail{i}.example.com and 10.0.{i % 250}.7 in {rng.integers(10**6)}", None, None, None) for i in range(300)]
    rows += [(1000, "call +1 (743) 555-3824 now; later (743) 555-3824 again, not 1234567", None, None, None), (1001, "only (743) 555-3824 here", None, None, None), (1002, None, None, None, None), (None, "", None, None, None)]
    found = {r.doc_id: r for r in pii.pii_scan(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [x.value for x in found[1000].found] == ["+1 (743) 555-3824", "(743) 555-3824"]
    assert found[1000].n_phone == 1 and found[1001].spans == found[1002].spans == ""
    assert sum(len(r.found) for i, r in found.items() if i is not None and i < 1000) == 900
    assert pii.pii_scan(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def toy(kind, n=500):
    """Documents whose label the text shows."""
    rng = np.random.default_rng(9)
    common_words = ["".join(rng.choice(list("aeiourstln"), 5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(common_words, 60))
        bad = bool(i % 3 == 0)
        if bad and kind == "toxic":
            for p in rng.choice(60, 3, replace=False):
                w[p] = "grumzo" + rng.choice(list("aeiou"))
        text = " ".join(w) if not (bad and kind == "quality") else "\n".join(" ".join(x.upper() + "!!" for x in w[k : k + 10]) for k in range(0, 60, 10))
        rows.append((i, text, 0.0, None, None))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    rows += [(n, None, None, None, None), (n + 1, "", None, None, None), (None, "stray", None, None, None)]
    return rows, labels + [(None, 1), (3, None)]


@pytest.mark.parametrize("kind, run, parts, held", [("toxic", toxicity.toxicity, 3, 1), ("quality", quality.quality, 4, 2)])
def test_classifiers_hold_out(spark, kind, run, parts, held):
    rows, labels = toy(kind)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, f"doc_id long, {kind} int")
    found = run(spark, docs, known).collect()
    assert len(found) == len(rows)
    want = dict(labels)
    for r in found:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % parts == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    own = [r for r in found if r.held_out and want.get(r.doc_id) is not None]
    assert len(own) > 80 and sum(r.predicted == want[r.doc_id] for r in own) / len(own) > 0.97
    # Labels of one class, or none: defined scores, no failure.
    for part in (known.where(f"{kind} = 1"), known.where("false")):
        assert {0 <= r.score <= 1 for r in run(spark, docs, part).collect()} == {True}
    assert run(spark, docs.where("false"), known).count() == 0


@needs_data
@pytest.mark.parametrize("name, column", [("op8_toxicity", "toxic"), ("op9_quality", "quality")])
def test_classifiers_on_tables(spark, name, column):
    from causalframe.llm import registry

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = registry.QUERIES[name](spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[column] for r in found) / len(found) > 0.93


@pytest.mark.parametrize("kind, run", [("toxic", toxicity.toxicity), ("quality", quality.quality)])
def test_classifiers_on_very_long_texts(spark, kind, run):
    rows, labels = toy(kind)
    want = dict(labels)
    good, bad = (next(t for i, t, *_ in rows if want.get(i) == k) for k in ((0, 1) if kind == "toxic" else (1, 0)))
    for t in (good, bad):
        rows.append((9000 + len(rows), "\n".join([t] * 4000), None, None, None))
    found = {r.doc_id: r for r in run(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, f"doc_id long, {kind} int")).collect()}
    first, second = (found[r[0]].predicted for r in rows[-2:])
    assert (first, second) == ((0, 1) if kind == "toxic" else (1, 0))


def test_toxicity_ratios_against_the_formula():
    """Brute force over dictionaries: discounted counts of a class, backed by shared continuations."""
    import pyarrow as pa

    texts = ["the cat sat", "a bad cat", "bad bad bat", "then a mat", "", "tom bat"]
    label, fold = [0, 1, 1, 0, None, None], [1, 1, 2, 1, None, None]
    rows = pa.record_batch([pa.array(range(6), pa.int64()), pa.array(texts), pa.array(label, pa.int32()), pa.array(fold, pa.int32())], names=["doc_id", "text", "label", "fold"])
    (packed,) = toxicity._partial([rows], 1)
    ratios = toxicity.Ratios(toxicity._ratios(None, pa.Table.from_batches([packed])).to_pylist())
    every, seen = set(), ({}, {})
    for t, y in zip(texts, label, strict=True):
        for w in t.split():
            s = "\1" + w + "\2"
            for i in range(1, len(s)):
                pair = (s[max(0, i - toxicity.ORDER + 1) : i], s[i])
                every.add(pair)
                if y is not None:
                    seen[y][pair] = seen[y].get(pair, 0) + 1

    def shared(context, c):
        before = [x for x in every if x[0][1:] == context[1:]]
        total = len(before)
        own, follow = sum(x[1] == c for x in before), len({x[1] for x in before})
        d = toxicity.DISCOUNT
        return (max(own - d, 0) + d * follow / 256) / total if total else 1 / 256

    def own(k, context, c):
        here = {x[1]: n for x, n in seen[k].items() if x[0] == context}
        d, m = toxicity.DISCOUNT, toxicity.STRENGTH
        return (max(here.get(c, 0) - d, 0) + (m + d * len(here)) * shared(context, c)) / (m + sum(here.values()))

    words = sorted({w for t in texts for w in t.split()})
    got = ratios.words(pa.array([w.encode() for w in words], pa.large_binary()))
    for w, value in zip(words, got, strict=True):
        s = "\1" + w + "\2"
        want = sum(np.log(own(1, s[max(0, i - toxicity.ORDER + 1) : i], s[i]) / own(0, s[max(0, i - toxicity.ORDER + 1) : i], s[i])) for i in range(1, len(s)))
        assert value == pytest.approx(want, abs=1e-4), w


def test_quality_field_by_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 4, 5, 8])
    score, chain = rng.normal(size=8), rng.normal(size=(2, 2))
    p, moves, log_z = quality.Chains(first).marginals(score, chain)
    want_p, want_m, want_z = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:], strict=False):
        weights = {}
        for y in np.ndindex(*[2] * (b - a)):
            weights[y] = np.exp(sum(score[a + i] for i, s in enumerate(y) if s) + sum(chain[s, t] for s, t in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        want_z += np.log(z)
        for y, w in weights.items():
            for i, s in enumerate(y):
                want_p[a + i] += s * w / z
            for s, t in zip(y, y[1:], strict=False):
                want_m[s, t] += w / z
    np.testing.assert_allclose(p, want_p)
    np.testing.assert_allclose(moves, want_m)
    assert log_z == pytest.approx(want_z)


def test_pii_beliefs_are_exact_on_trees():
    rng = np.random.default_rng(6)
    g = pii.Graph(["a1 b2 c3 d4"])
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), np.zeros((pii.LABELS,) * 2))
    own = g.x @ field.own
    want = np.zeros((4, pii.LABELS))
    for y in np.ndindex(*[pii.LABELS] * 4):
        w = np.exp(sum(own[i, s] for i, s in enumerate(y)) + sum(field.chain[s, t] for s, t in zip(y, y[1:], strict=False)))
        for i, s in enumerate(y):
            want[i, s] += w
    np.testing.assert_allclose(field.marginals(g, rounds=60), want / want.sum(1, keepdims=True), rtol=1e-6)


PAGES = [
    ("https://www.Shop.example.com/en/1.html?x=1#t", "www.shop.example.com", "/en/1.html", "com/", "allow"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/7", "a.example.com", "/en/7", "example.com/en/", "block"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/", "allow"), ("ftp://x.net/es/q", "x.net", "/es/q", "net/es/", "block"),
    ("x.net/es/q", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("https://x.net?a=/fr/", "x.net", "", None, "allow"), ("https://com/", "com", "/", "com/", "allow"), ("http://u@ÉX.NET/fr/", "u@Éx.net", "/fr/", "net/fr/", "block"),
]


@pytest.mark.parametrize("literal", [200, 0])
def test_url_rules(spark, monkeypatch, literal):
    monkeypatch.setattr(url_filter, "LITERAL_RULES", literal)
    # A rule wins for shop.example.com/en too.
    want = [(u, h, p, "example.com/en/" if h == "www.shop.example.com" else r, "block" if h == "www.shop.example.com" else v) for u, h, p, r, v in PAGES]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, (u, *_) in enumerate(want)] * 2, "page_id long, url string, host string, verdict int")
    labels = spark.createDataFrame([], "url string, label string")
    found = url_filter.url_filter(spark, pages, url_filter.RULES, labels).collect()
    assert len(found) == 2 * len(want)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id][1:]


def test_url_rules_are_mined(spark):
    rows = [(f"https://{'spam' if i % 4 == 0 else 'good'}{i % 7}.org/{'buy' if i % 4 == 0 else 'read'}/{i}", "block" if i % 4 == 0 else "allow") for i in range(200)]
    labels = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame([(1, "https://new.org/buy/77"), (2, "https://new.org/read/77"), (3, "https://new.org/other")], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.url_filter(spark, pages, url_filter.RULES, labels).collect()}
    assert [found[i].verdict for i in (1, 2, 3)] == ["block", "allow", "allow"]
    assert found[1].mined_rule == "p0:buy" and found[3].mined_rule is None


@pytest.mark.parametrize("literal", [200, 0])
def test_of_equally_long_rules_the_first_counts(spark, monkeypatch, literal):
    monkeypatch.setattr(url_filter, "LITERAL_RULES", literal)
    pages = spark.createDataFrame([(1, "http://b.com/abc"), (2, "http://x.b.com/ab/"), (3, "http://b.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, label string")
    one, two = ("com", "/ab", "block"), ("b.com", "/", "allow")
    assert len(one[0] + one[1]) == len(two[0] + two[1])
    for rules, want in (([one, two], ["com/ab", "com/ab", "b.com/"]), ([two, one], ["b.com/"] * 3), ([one, ("com", "/ab", "allow")], ["com/ab", "com/ab", None])):
        found = {r.page_id: r for r in url_filter.url_filter(spark, pages, rules, none).collect()}
        assert [found[i].rule for i in (1, 2, 3)] == want
        assert found[1].verdict == ("block" if want[0] == "com/ab" else "allow")


@pytest.mark.parametrize("most", [12, 0])
def test_url_verdicts_against_all_subsets(spark, monkeypatch, most):
    """Brute force: every set of tokens of every labelled URL, with its rows of either label."""
    from collections import Counter
    from itertools import combinations
    from math import ceil

    from pyspark.sql import functions as F

    monkeypatch.setattr(url_filter, "FP_ITEMS", most)
    rng = np.random.default_rng(11)

    def url():
        return f"https://{rng.choice(['a', 'b'])}.{rng.choice(['org', 'co.uk'])}/{rng.choice(['x', 'y', 'z'])}/{rng.integers(99)}{rng.choice(['', '.html', '?q=1'])}"

    def label(u):
        return "block" if ("b.org" in u and "/y/" in u) or ("/z/" in u and ".html" in u) or rng.random() < 0.08 else "allow"

    known = [(u, label(u)) for u in (url() for _ in range(240))]
    pages = [(i, url()) for i in range(60)] + [(90, None), (91, "no url")]
    host, path = url_filter.host_path(F.col("url"))
    tokens = url_filter.url_tokens(F.col("url"), F.col("host"), F.col("path"))
    of = {r.url: frozenset(r.t) for r in spark.createDataFrame([(u,) for u, _ in known + [(p[1], 0) for p in pages if p[0] < 90]], "url string").withColumns({"host": host, "path": path}).select("url", tokens.alias("t")).collect()}
    rows, both = Counter(), Counter()
    for u, verdict in known:
        for n in range(1, len(of[u]) + 1):
            for x in combinations(sorted(of[u]), n):
                rows[x] += 1
                both[x, verdict] += 1
    support, confidence = 0.02, 0.85
    rules = [(c / rows[x], c / len(known), v, frozenset(x)) for (x, v), c in both.items() if c >= ceil(support * len(known)) and c / rows[x] >= confidence]
    found = {r.page_id: r for r in url_filter.url_filter(spark, spark.createDataFrame(pages, "page_id long, url string"), [], spark.createDataFrame(known, "url string, label string"), support, confidence).collect()}
    assert len(found) == len(pages)
    verdicts = set()
    for i, u in pages:
        best = max((r[:3] for r in rules if r[3] <= of.get(u, set())), default=None)
        assert found[i].verdict == (best[2] if best else "allow") and (found[i].mined_rule is None) == (best is None)
        verdicts.add(found[i].verdict)
    assert verdicts == {"allow", "block"}


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline
    from causalframe.llm import common

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.store(spark, stage(spark, docs, DATA), "stage")
        assert out.columns == docs.columns
        assert out.exceptAll(docs).count() == 0
        docs = out
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[0] > n[1] > n[2] > n[3] > n[4] > 0.5 * n[0]
    texts = [r.text.lower() for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == len(texts)
    common.release(spark)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toy("quality", 200)
    rows += [(None, "stray", None, None, None), rows[4], rows[4]]
    schema = "doc_id long, text string, lang string, score string, predicted long, held_out string, kept boolean, sha string, label string, bad_lines int, rid int"
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", i, None, True, "x", "y", 3, 4) for i, t, *_ in rows], schema)
    root = f"file://{tmp_path}"
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "not there at all")], "item_id int, text string").write.parquet(f"{root}/benchmark.parquet")
    own = set(docs.collect())
    for f in (corpus_pipeline.keep_good, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_leaks):
        assert (out := f(spark, docs, root)).dtypes == docs.dtypes and set(out.collect()) <= own
    n, distinct = corpus_pipeline.drop_copies(spark, docs, root).selectExpr("count(*)", "count(distinct lower(coalesce(text, '')))").first()
    assert n == distinct == docs.selectExpr("count(distinct lower(coalesce(text, '')))").first()[0]
    found = corpus_pipeline.run(spark, root)
    good = {i for i, q in labels if q == 1 and i is not None}
    assert good <= {r.doc_id for r in found.select("doc_id").distinct().collect()}
    empty = f"{root}/empty"
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{t}.parquet").write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """What the classifier keeps, then the other stages by their definitions, down to the ids
    of every document that is left."""
    from collections import defaultdict

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    rng = np.random.default_rng(21)
    rows, labels = toy("quality", 160)
    rows = [(i, t) for i, t, *_ in rows if i is not None]
    good = {i for i, q in labels if q == 1}
    source = [t for i, t in rows if i in good and t]
    passage = " ".join(f"secretword{k}" for k in range(9))
    for k in range(60):
        w = source[k % 25].split()
        at = int(rng.integers(0, len(w) - 8))
        n = int(rng.integers(1, 7))
        changed = [" ".join(w).upper() if k % 12 == 0 else " ".join(w), " ".join([*w[:at], *(f"new{k}x{j}" for j in range(n)), *w[at + n :]]), " ".join([*w[:at], *passage.split()[: 9 if k % 3 else 7], *w[at:], f"end{k}"])][k % 3]
        rows.append((1000 + k, changed))
    root = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    bench = [(1, passage), (2, "nothing of this is anywhere in the corpus at all"), (3, None)]
    spark.createDataFrame(bench, "item_id int, text string").write.parquet(f"{root}/benchmark.parquet")

    left = {r.doc_id: r.text for r in corpus_pipeline.keep_good(spark, docs, root).collect()}
    assert len(left) > 100
    groups = defaultdict(list)
    for i, t in left.items():
        groups[lower(t)].append(i)
    left = {max(ids): left[max(ids)] for ids in groups.values()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in left.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    up = {i: i for i in left}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in left:
        for j in left:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    near = len(left)
    left = {i: t for i, t in left.items() if find(i) == i}
    assert len(left) < near
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for _, t in bench:
        w = token.findall(lower(t))
        windows |= {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    leaks = {i for i, t in left.items() if {tuple(w[k : k + 8]) for w in [token.findall(lower(t))] for k in range(len(w) - 7)} & windows}
    assert leaks
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in left.items() if i not in leaks}
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.run(spark, root).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(ids) > 0 and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id] += r.length
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in want.items()}
    assert max(sequences.values()) <= 2048


def test_long_urls_stay_bounded(spark):
    urls = ["https://a.org/" + "x/" * 20_000, "b://" + "c." * 3000, "https://a.org/" + "y/" * 20_000 + "?" + "k=1&" * 5000 + "#f"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(u, "block") for u in urls] * 3, "url string, label string")
    found = url_filter.url_filter(spark, pages, url_filter.RULES, labels).collect()
    assert [r.verdict for r in found] == ["block"] * 3


def test_long_texts_take_linear_time():
    hint = dict.fromkeys(pii.HINTS, True)
    for text in ("1.2." * 40_000, "a@" + "b." * 40_000, "x@" * 40_000, "+1 " * 40_000, "1 " * 40_000, "a" * 400_000 + " 1.2.3.4", "+1 (743) 555-3824 " * 3000):
        base = pii.base_spans(text, hint)
        assert sorted(base) == pii_base(text) if len(text) < 200_000 else base
        graph = pii.Graph([text])
        assert len(pii._labels(graph, [base])) == len(graph.spans)
        assert len(graph.skip) <= 2 * len(graph.spans)


@pytest.mark.parametrize("most", [12, 0])
def test_url_rules_on_any_token(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "FP_ITEMS", most)
    bad = ["https://a{}.net/x/y/casino/{}", "https://a{}.net/x/y/z/{}?page=2&ref=x", "https://blog.adult-x.a{}.co.uk/x/y/z/{}"]
    good = ["https://a{}.net/x/y/news/{}", "https://a{}.net/x/y/z/{}?page=2&lang=x", "https://blog.garden.a{}.co.uk/x/y/z/{}"]
    rows = [(u.format(i % 5, i), label) for label, urls in (("block", bad), ("allow", good * 3)) for u in urls for i in range(20)]
    labels = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame([(k, u.format("new", 7)) for k, u in enumerate(bad + good)], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.url_filter(spark, pages, [], labels).collect()}
    assert [found[k].verdict for k in range(6)] == ["block"] * 3 + ["allow"] * 3
    assert found[0].mined_rule == "p2:casino" and found[1].mined_rule == "q:ref"


def test_url_rules_by_size_are_those_of_fp_growth(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        has = rng.random(7) < 0.5
        rows.append(([x for x, h in zip("abcdefg", has, strict=True) if h], "block" if (has[0] and has[3] and not has[5]) or rng.random() < 0.1 else "allow"))
    rows = spark.createDataFrame(rows, "items array<string>, label string")
    mined = []
    for most in (12, 0):
        monkeypatch.setattr(url_filter, "FP_ITEMS", most)
        mined.append({(tuple(r.antecedent), r.verdict, round(r.confidence, 9), round(r.support, 9)) for r in url_filter.pruned(url_filter.mine_rules(spark, rows, 0.01, 0.8)).collect()})
    assert mined[0] == mined[1] and max(len(a) for a, *_ in mined[0]) > 2


def test_pii_field_needs_no_pattern(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"ab e.{i}@mail{i}.example.com cd +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} in {rng.integers(10**6)}", None, None, None) for i in range(300)]
    odd = "write to müller@exämple.de today"
    rows += [(1000, odd, None, None, None), (1001, f"{odd} not to 10.0.0.7", None, None, None), (1002, "on 12 May 2020 at 5 pm", None, None, None)]
    found = {r.doc_id: r for r in pii.pii_scan(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(x.kind, x.value) for x in found[1000].found] == [("email", "müller@exämple.de")]
    assert [(x.kind, x.value) for x in found[1001].found] == [("email", "müller@exämple.de"), ("ip", "10.0.0.7")]
    assert found[1000].n_email == 0 and found[1002].spans == ""


def test_pii_bound_holds():
    rng = np.random.default_rng(8)
    skipped = 0
    for _ in range(300):
        g = pii.Graph([" ".join(rng.choice(["a1", "b2", "x", "5551234567", "c3\n\n"], 12))])
        field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)) - np.eye(1, pii.LABELS) * -0.8, rng.normal(size=(pii.LABELS,) * 2) / 2, rng.normal(size=(pii.LABELS,) * 2) / 2)
        if field.hopeless(g):
            skipped += 1
            assert not len(g.spans) or field.marginals(g)[:, 1:].max() < pii.SURE
    assert skipped > 10


def test_pipeline_drops_near_copies_of_five_words(spark):
    """The stage against brute force: five-word shingles, 80 of 100."""
    import corpus_pipeline

    rng = np.random.default_rng(7)
    rows = []
    for i in range(12):
        w = [f"t{i}x{k}" for k in range(100)]
        rows.append(w)
        for n in (4, 6, 7, 9):
            at = int(rng.integers(0, 100 - n))
            rows.append(w[:at] + [f"r{len(rows)}x{k}" for k in range(n)] + w[at + n :])
    w = [f"s{k}" for k in range(100)]
    rows += [w, w[:40] + ["o"] * 6 + w[46:]]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()}
    assert kept == {i for i in range(len(rows)) if find(i) == i} and len(rows) - 1 not in kept


@pytest.mark.parametrize("data, kind", [(RSA, "der_key"), (SSH, "ssh_key"), (openssh(b"aes256-ctr", b"bcrypt", fields(b"salt" * 4, b"\0\0\0\x10"), private=b"\x5b" * 160), "ssh_key"), (ENCRYPTED, "der_key"), (EC, "der_key"), (ED25519, "der_key")])
@pytest.mark.parametrize("before", ["private_key=", "cert==", "A" * 45 + "=", "x/", "keys/of/all-", "my_", "private_key: ", "+"])
def test_secrets_after_any_sign(data, kind, before):
    hint = dict.fromkeys(secrets.HINTS, True)
    for key in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("=")):
        text = f"{before}{key} end"
        assert [(k, text[a:b]) for k, a, b in secrets.find(text, hint)[1]] == [(kind, key)]


_BITS = der(0x03, b"\0" + der(0x30, der(0x02, b"\x7f" * 65) + der(0x02, b"\x01\0\x01")))
PUBLIC = [
    SSH_PUBLIC, fields(b"ssh-rsa", b"\x01\0\x01", b"\0" + b"\x7f" * 128), fields(b"ecdsa-sha2-nistp256", b"nistp256", b"\x04" * 65),
    der(0x30, der(0x30, der(0x06, bytes.fromhex("2a864886f70d010101")) + der(0x05, b"")) + _BITS), der(0x30, der(0x02, b"\x7f" * 65) + der(0x02, b"\x01\0\x01")),
]
BROKEN = [
    b"openssh-key-v1\0" + b"\xff" * 40, b"openssh-key-v1\0" + b"\x05" * 60, SSH[:-1], SSH[:-8], SSH + b"\0" * 8, openssh(n=2), openssh(n=0), openssh(public=b"\x07" * 51), openssh(b"none", b"bcrypt", b"x"),
    openssh(private=b"\x01" * 4 + b"\x02" * 4 + _PRIVATE[8:]), openssh(private=_PRIVATE[:8] + fields(b"ssh-rsa", b"\x07" * 32, b"\x09" * 64) + b"\1"), openssh(b"aes256-ctr", b"none", b""), openssh(b"a b", b"none", b""),
    ENCRYPTED[:-1], der(0x30, der(0x30, der(0x06, b"\x2a\x03")) + der(0x04, b"\x5a" * 64)), EC[:-3], ED25519[:-1], RSA + b"\0",
]


@pytest.mark.parametrize("data", PUBLIC + BROKEN)
def test_what_is_no_private_key_is_not_confirmed(data):
    hint = dict.fromkeys(secrets.HINTS, True)
    body = base64.b64encode(data).decode()
    for text in (body, f"ssh-rsa {body} me@home", data.hex(), f"x=/{body}", f"-----BEGIN OPENSSH PRIVATE KEY-----\n{body}\n-----END OPENSSH PRIVATE KEY-----"):
        assert secrets.find(text, hint)[1] == []


@pytest.mark.parametrize("data", [RSA, SSH, ENCRYPTED, EC, ED25519])
@pytest.mark.parametrize("line_end", ["\n", "\r\n", "\\n", "\\r\\n"])
def test_armoured_blocks(data, line_end):
    body = base64.b64encode(data).decode()
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    block = line_end.join(["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"])
    found = secrets.find(f"a {block} b", dict.fromkeys(secrets.HINTS, True))[1]
    assert ("armoured_key", 2, 2 + len(block)) in found


def test_secrets_within_a_run():
    hint = dict.fromkeys(secrets.HINTS, True)
    key = base64.b64encode(RSA).decode().rstrip("=")
    text = f"a/{key}/{key}-x {key[:-4]} b/{key[:-4]}"
    assert [text[a:b] for _, a, b in secrets.find(text, hint)[1]] == [key, key]
    assert secrets.find("/MIIEvQIBADAN" * 40_000, hint)[1] == []


def test_pii_repetitions_far_from_a_sure_mention(spark):
    rng = np.random.default_rng(5)

    def number():
        return f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"

    rows = [(i, f"ab +1 {number()} cd e.{i}@mail{i}.example.com and 10.0.{i % 250}.7 in {rng.integers(10**6)}", None, None, None) for i in range(300)]
    field = pii.fit(spark, spark.createDataFrame(rows, SCHEMA))
    bare, full = ["555-3824"] * 60, "+1 (743) 555-3824"
    for at in (0, 30, 60):
        text = " and then again ".join([*bare[:at], full, *bare[at:]])
        base = pii.base_spans(text, dict.fromkeys(pii.HINTS, True))
        graph = pii.Graph([text], [base])
        added = {x[1] for x in pii.added_spans(text, graph, range(len(graph.spans)), field.marginals(graph), base)}
        starts = [m.start() for m in re.finditer(r"555-3824", text)]
        # All but those at an end or next to the sure one, which have a tie less.
        assert added >= {s for k, s in enumerate(starts) if 0 < k < 60 and abs(k - at) > 1}


def test_pii_sample_is_bounded(spark, monkeypatch):
    """Of hinted texts only about as many as wanted reach the driver, whatever repeats."""
    seen = []
    monkeypatch.setattr(pii, "mentions", lambda texts, f=pii.mentions: seen.append(list(texts)) or f(texts))
    rows = [(i, f"call +1 (743) 555-{i:04d} or e.{i}@mail.example.com", None, None, None) for i in range(3000)]
    rows += [rows[0]] * 2000 + [(9000, "long 10.0.0.7 " * 5000, None, None, None), (9001, None, None, None, None), (9002, "none", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    pii.fit(spark, docs, 100)
    pii.fit(spark, docs.repartition(7), 100)
    assert seen[0] == seen[1] and len(seen[0]) == len(set(seen[0])) == 100
    pii.fit(spark, docs.where("doc_id > 9000"), 100)
    assert seen[2] == []


def test_pii_messages_settle():
    graph = pii.Graph([" and ".join(["5551234567 a1 b2"] * 80)])
    own, tables = np.random.default_rng(3).normal(size=(pii.FEATURES, pii.LABELS)), np.random.default_rng(4).normal(size=(2, pii.LABELS, pii.LABELS)) / 4
    field = pii.Field(own, *tables)
    np.testing.assert_allclose(field.marginals(graph), field.marginals(graph, rounds=4000), atol=1e-6)
