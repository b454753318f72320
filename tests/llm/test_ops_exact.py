"""Exact operators against brute force on a small fixture with awkward rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from causalframe.llm import common, decontaminate, exact_dedup, fm_index, ngram_join, packing, substring_dedup

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, kept string, score double, rid long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def make_rows():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünder", "élan", "ñu", "日本"]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (60, 60, 90, 25, 19, 20, 8, 3, 120, 300)]
    texts += [texts[0].upper(), texts[0], texts[1] + " tail", texts[2].replace(" ", "\n\t", 5), texts[8][:200] + " changed " + texts[8][200:]]
    texts += [" ".join(texts[9].split()[50:90]) + " x " + texts[3], "", "   ", None, None, "one", "One", "\x1c\x85 a b", "É é", "a " * 100, "A " * 100 + "b"]
    texts += ["long " + " ".join(rng.choice(vocabulary, 9000))] * 2 + ["w1 <|endoftext|> w2<|endoftext|><|endoftext|>", "cut <|endof", "text|> here"]
    rows = [(i, t, "en", "x", 0.5, 7) for i, t in enumerate(texts)]
    # Rows that repeat, ids that are null or stand for two texts.
    rows += [rows[3], rows[3], (None, texts[4], None, None, None, None), (None, "other", None, None, None, None), (5, texts[6] + " more", "en", None, None, 1)]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, empty):
    found = exact_dedup.exact_dedup(spark, docs, block_bytes=16).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1])].append(r[0])
    assert len(found) == len(ROWS)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(spark, empty).count() == 0


def test_exact_dedup_blocks_do_not_matter(spark, docs):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    a, b = (sorted(map(str, exact_dedup.exact_dedup(spark, docs, block_bytes=n).select(columns).collect())) for n in (7, 4096))
    assert a == b


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [("i1", " ".join(ROWS[9][1].split()[60:72])), ("i2", " ".join(ROWS[9][1].split()[80:95]) + " nowhere"), ("i2", "one"), (None, "w1"), ("null", "w2"), ("i4", ""), ("i5", None), ("i6", " ".join(ROWS[8][1].split()[:8]).upper())]


def brute_leaks(text):
    w = WORDS.findall(lower(text))
    hit, items = set(), set()
    for item, t in ITEMS:
        q = WORDS.findall(lower(t))
        for a in range(max(1, len(q) - 7) if q else 0):
            window = q[a : a + 8]
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    items.add(item)
    return len(w), len(hit), sorted(items, key=lambda i: (i is None, i or ""))


@pytest.mark.parametrize("block", [10**6, 20, 3])
def test_decontaminate(spark, docs, empty, block):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = decontaminate.decontaminate(spark, docs, bench, block_windows=block)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found.collect())
    want = sorted((str(r[0]), *(x := brute_leaks(r[1])), len(x[2]) >= 2) for r in ROWS)
    assert got == want
    assert decontaminate.decontaminate(spark, empty, bench).count() == 0
    assert decontaminate.decontaminate(spark, docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b x c d e f g h"), (3, "a b x x x c d e f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id int, text string")
    found = {r.doc_id: (r.n_near, len(r["items"])) for r in decontaminate.decontaminate(spark, docs, bench, slop=1).collect()}
    assert found == {1: (1, 1), 2: (1, 0), 3: (0, 0)}


@pytest.mark.parametrize("window, open_windows, fan_in", [(2048, 64, 32), (64, 3, 2), (7, 1, 2)])
def test_packing_round_trip(spark, docs, empty, window, open_windows, fan_in):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    found = packing.pack(spark, docs, TOKENIZER, window, open_windows, 2, fan_in, keep_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id, r.doc_tokens].append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    total = sum(r.length for r in found)
    # Every document's ids, once for each of its rows.
    want = defaultdict(list)
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[r[0], len(ids)].append(np.array(ids, "<u4").tobytes())
    assert set(want) == set(pieces)
    for key, texts in want.items():
        assert sum(r.length for r in pieces[key]) == sum(len(x) // 4 for x in texts)
        if len(texts) == 1:
            assert b"".join(r.ids for r in sorted(pieces[key], key=lambda r: r.start)) == texts[0]
    padding = sum(window - sum(r.length for r in rows) for rows in sequences.values())
    assert padding <= window + 2 * len(sequences) and total > 0
    assert packing.pack(spark, empty, TOKENIZER).count() == 0


def test_encoder_splits_like_the_whole():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t", "a", "b'", "'s", " ", "　", "é", "1", "!", "\x1c", "\x85", "<|endoftext|>", "<|endof", "text|>", "word", " ", "\r\n", " '", "'ll ", "€,", "漢"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    import pyarrow as pa

    t = Tokenizer.from_file(TOKENIZER)
    ids, at = packing.TextEncoder(TOKENIZER).encode(*common.text_bytes(pa.array(texts)))
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert list(ids[at[i] : at[i + 1]]) == e.ids


SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(k):
    """Occurrences in order of (doc_id, start), null first."""
    starts = defaultdict(set)
    tokens = [SPACED.findall(r[1] or "") for r in ROWS]
    keys = [(r[0] is not None, r[0] or 0) for r in ROWS]
    for key, w in zip(keys, tokens, strict=True):
        for p in range(len(w) - k + 1):
            starts[tuple(w[p : p + k])].add((key, p))
    out = []
    for r, key, w in zip(ROWS, keys, tokens, strict=True):
        gone = set()
        for p in range(len(w) - k + 1):
            if min(starts[tuple(w[p : p + k])]) < (key, p):
                gone.update(range(p, p + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(r[0]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("k, m, fan_in, files", [(20, 8, 256, 0), (5, 3, 256, 0), (5, 3, 2, 7), (20, 8, 2, 4), (5, 3, 3, 1)])
def test_substring_dedup(spark, docs, empty, tmp_path, monkeypatch, k, m, fan_in, files):
    if files:
        # Several levels of shards, and shards of a few windows.
        monkeypatch.setattr(substring_dedup, "TASK_WINDOWS", 50)
        monkeypatch.setattr(substring_dedup, "PIECE", 7)
        docs.repartition(files).write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
        monkeypatch.setattr(common, "task_count", lambda df: files)
        monkeypatch.setattr(common, "groups", lambda df, width, size: 16)
        monkeypatch.setattr(common, "filter_log2", lambda df, bits: 12)
    found = substring_dedup.substring_dedup(spark, docs, k, m, fan_in)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == brute_substring(k)
    assert substring_dedup.substring_dedup(spark, empty).count() == 0


def brute_components():
    sets, keys = [], []
    for r in ROWS:
        w = SPACED.findall(lower(r[1]))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
        keys.append(r[0])
    root = list(range(len(ROWS)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        known = [x for x in (least.get(find(i)), k) if x is not None]
        least[find(i)] = min(known, default=None)
    return sorted((str(k), len(s), str(least[find(i)] if s else k)) for i, (k, s) in enumerate(zip(keys, sets, strict=True)))


@pytest.mark.parametrize("hot", [100_000, 1])
def test_ngram_join(spark, docs, empty, monkeypatch, hot):
    # With hot = 1 most shingles that repeat are dealt out over several groups.
    monkeypatch.setattr(ngram_join, "HOT", hot)
    found = ngram_join.ngram_join(spark, docs)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == brute_components()
    assert ngram_join.ngram_join(spark, empty).count() == 0


@pytest.mark.parametrize("kind, hot", [("copies", 100_000), ("copies", 5), ("forms", 100_000), ("mixed", 5)])
def test_ngram_join_of_many_near_copies(spark, monkeypatch, kind, hot):
    """Chains and clusters around the threshold in one large group, and a form with many
    fillings, of which only some come near one another."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = np.random.default_rng(8)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        if kind == "copies" or (kind == "mixed" and i % 2):
            for p in rng.choice(120, int(rng.integers(0, 7)), replace=False):
                w[p] = f"x{rng.integers(5000)}"
        else:
            n = int(rng.integers(2, 16))
            w[50 : 50 + n] = [f"y{rng.integers(4)}x{j}" for j in range(n)] if i % 5 else [f"z{i}x{j}" for j in range(n)]
            w += [f"e{j}" for j in range(int(rng.integers(0, 9)))]
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    found = ngram_join.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: find(i) for i in range(len(rows))}


def test_fm_index_against_counting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        k, sigma = int(rng.integers(1, 9)), int(rng.integers(2, 5))
        n = rng.integers(0, 12, int(rng.integers(1, 8)))
        first = np.concatenate([[0], np.cumsum(n)])
        text = rng.integers(0, sigma, first[-1])
        if not len(text):
            continue
        index = fm_index.FMIndex(text, first, k)
        qn = rng.integers(0, 15, 5)
        qf = np.concatenate([[0], np.cumsum(qn)])
        q = rng.integers(0, sigma + 1, qf[-1])
        lo, hi = index.stream(q, qf)
        for a, b in zip(qf, qf[1:], strict=False):
            for p in range(a, b):
                window = q[p : p + k]
                want = sum((text[i : i + k] == window).all() for x, y in zip(first, first[1:], strict=False) for i in range(x, y - k + 1)) if p + k <= b else 0
                assert hi[p] - lo[p] == want
        # A large alphabet packs fewer symbols into the first key.
        wide = text * (2**29 // sigma)
        assert (np.diff(fm_index.suffix_order(wide, k)[1][fm_index.suffix_order(wide, k)[0]]) >= 0).all()


def test_bloom_never_loses():
    h = common.mix(np.arange(5000, dtype=np.uint64))
    b = common.Bloom.empty(16)
    b.add(h)
    assert b.has(h).all() and b.has(common.mix(h + np.uint64(7))).mean() < 0.2


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_tables_are_merged_level_by_level(spark, monkeypatch, fan_in):
    monkeypatch.setattr(common, "task_count", lambda df: 13)

    def run(batches):
        table = np.zeros(64, np.uint32)
        for b in batches:
            np.add.at(table, b.column(0).to_numpy() % 64, 1)
        yield common.table_slices(table)

    found = common.merge_tables(common.map_arrow(spark.range(1000).repartition(13), run, "part int, blob binary"), "uint32", "add", fan_in)
    assert found.tolist() == np.bincount(np.arange(1000) % 64, minlength=64).tolist()
    bits = common.bloom_of(spark.range(500).repartition(9), ["id"], 14)
    assert common.Bloom(bits).has(np.arange(500, dtype=np.uint64)).all()


def test_components(spark):
    from causalframe.llm.components import components

    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
    # One edge the wrong way round, or a star from the start.
    assert {r.node: r.root for r in components(spark, spark.createDataFrame([(1, 2)], "a long, b long")).collect()} == {1: 1, 2: 1}
    assert {r.node: r.root for r in components(spark, spark.createDataFrame([(2, 1), (3, 1)], "a long, b long")).collect()} == {1: 1, 2: 1, 3: 1}


def test_store_uses_the_shared_folder(spark):
    path = common.store(spark, spark.range(3), "x").inputFiles()[0]
    assert common.shared_root(spark) in path
    at = common.mark()
    later = common.store(spark, spark.range(4), "y").inputFiles()[0]
    common.release(spark, at)
    assert spark.read.parquet(path).count() >= 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(later)
    common.release(spark)


def test_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    common.tune(spark)
    common.tune(spark)
    assert spark.conf.get(key) == "4096"
    common.release(spark)
    assert spark.conf.get(key) == before


def test_proximity_at_the_edges_of_a_text(spark):
    full = "a b c d e f g h"
    # The rarest terms, b and g, stand at the edge; texts 5 and 6 have a term only in the text before or after.
    texts = [(1, "b a c d e f g h"), (2, "a c d e f h"), (3, "a b c d e f h g"), (4, full), (5, "x a"), (6, "x b c d e f g h"), (7, "a b c d e f g x"), (8, "h a c d e f h")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, full)], "item_id int, text string")
    found = {r.doc_id: (r.n_near, r.n_hit) for r in decontaminate.decontaminate(spark, docs, bench, slop=2).collect()}
    want = {i: (0, 0) for i, _ in texts} | {1: (1, 0), 3: (1, 0), 4: (1, 8)}
    assert found == want


def test_proximity_is_a_query(spark, tmp_path):
    from causalframe.llm import registry

    passage = "the quick brown fox jumps over a dog"
    docs = [(1, f"so {passage} then"), (2, f"so {passage.replace('fox', 'red fox')} then"), (3, "nothing of it")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near, exact = (registry.QUERIES[q](spark, str(tmp_path)) for q in ("op2_near", "op2_decontaminate"))
    assert {r.doc_id: (r.n_hit, r.n_near) for r in near.collect()} == {1: (8, 1), 2: (0, 1), 3: (0, 0)}
    assert near.drop("n_near").exceptAll(exact).count() == 0 and "n_near" not in exact.columns
