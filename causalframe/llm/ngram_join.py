"""N-gram Jaccard self-join with rare-first prefix, length, positional and suffix filters.

A text's set is its distinct word shingles. Equal sets are one node. Each node's
shingles are ordered by how often the corpus has them, rarest first. Two nodes whose
Jaccard similarity reaches the threshold t share at least l of their first
n - ceil(t * n) + l, whatever l is; these prefixes are dealt out by shingle, once per
node and task. A node with fewer than l prefix shingles that other nodes have too links
with nothing and is done. The join itself works on the prefixes for l = 1.

Where many nodes share a prefix shingle, most of their pairs would only confirm what
a few show. So the first round links the nodes of each group to those few of it that
share most with others, verifies these pairs and merges what they connect. The second
takes every pair of nodes that share a prefix shingle but not yet a component, as far
as the filters let them link, and verifies each once. No link between components is
lost: in each group the nodes outside its largest component meet the whole group, and
of two nodes the one with the smaller set must have the shingle early enough to reach
the threshold with a set of its own size.

A shingle that very many documents have is dealt out over several groups by node; its
records count as shared without a look at the other groups.

The frequency table has a fixed number of slots; it only orders shingles, so shared
slots cost work, never results. So does the filter that picks which texts' sets are
fetched for verification.

Defined results: null or wordless texts have an empty set, link with nothing and are
their own component; fewer words than a shingle make one shingle; a null doc_id joins
its component but never names one that has another id; rows that repeat share a
component; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalframe.llm import common
from causalframe.llm.common import U64
from causalframe.llm.components import components

SHINGLE_WORDS = 4
THRESHOLD = 85
SLOTS_LOG2 = 21
#: Documents of a slot, beyond four times the mean, for each group that its shingles are dealt over.
HOT = 100_000
#: Bytes of input for each group of shingles or nodes.
GROUP_BYTES = 5 << 19
#: Bins of a set's hashes for the suffix filter.
BINS = 256

#: Pairs of a node in the first round; the second takes all that are left.
STAR_PAIRS = 4

#: A node is told by 96 bits of its set's digest (hi, lo) and its size n. Places beyond
#: 65,535 count as that, which only weakens the positional filter. spread: the number of
#: groups that the shingle is dealt over.
_REC = np.dtype([("token", "<u8"), ("hi", "<u8"), ("lo", "<u4"), ("n", "<u4"), ("pos", "<u2"), ("spread", "<u2")])
_DOC = np.dtype([("doc", "<i8"), ("known", "<i4"), ("n", "<u4"), ("hi", "<u8"), ("lo", "<u4")])


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    data, offsets = common.text_bytes(column)
    data = common.lower(data)
    s, e, first = common.words(data, offsets, common.SPACED)
    codes, dictionary = common.word_codes(data, s, e)
    h = common.hash_bytes(dictionary)[codes] if len(codes) else np.zeros(0, U64)
    grams = common.gram_hash(h, k)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            # A whole short text, told apart by its length.
            out.append(common.gram_hash(h[a:b], int(b - a)) ^ common.mix(np.array([b - a], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _node(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return x >> 64, x & (2**32 - 1)


def least_shared(n):
    """l of a set of n shingles. Two sets that link share at least the smaller one's l in their prefixes."""
    return 1 + n // 25


def least_overlap(n: np.ndarray, t: int) -> np.ndarray:
    return (t * n + 99) // 100


def _frequencies(docs: DataFrame, k: int, log2: int) -> np.ndarray:
    """How many documents have a shingle of each slot."""
    mask = U64((1 << log2) - 1)

    def run(batches):
        table, waiting, held = np.zeros(1 << log2, np.uint32), [], 0

        def settle() -> None:
            table[:] += np.bincount(np.concatenate(waiting), minlength=1 << log2).astype(np.uint32)
            waiting.clear()

        for b in common.text_slices(batches):
            waiting += [(s & mask).astype(np.uint32) for s in shingle_sets(b.column(1), k)]
            held += sum(map(len, waiting[-b.num_rows :]))
            if held > 1 << log2:
                settle()
                held = 0
        if waiting:
            settle()
        yield common.table_slices(table)

    return common.merge_tables(common.map_arrow(docs, run, "part int, blob binary"), "uint32", "add")


def _dealt(r: np.ndarray, by: str, buckets: int) -> list[tuple]:
    """Records by bucket of one of their fields, packed. A shingle that is spread out has a
    bucket for each remainder of its nodes."""
    value = r[by]
    if by == "token" and len(r) and r["spread"].max() > 1:
        with np.errstate(over="ignore"):
            value = value + (common.mix(r["hi"]) % r["spread"].astype(U64)) * common.K1
    home = (common.mix(value) % U64(buckets)).astype(np.int32)
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(buckets + 1))
    return [(i, 0, r[order[a:b]].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


_BLOB = "bucket int, kind int, blob binary"
_BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB_ARROW)], schema=_BLOB_ARROW)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, list[tuple]]:
    """Records of a bucket, and its rows of documents as they are."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True))
    return np.concatenate([np.zeros(0, _REC), *(np.frombuffer(x, _REC) for _, k, x in rows if k == 0)]), [r for r in rows if r[1] == 1]


def _shared(r: np.ndarray) -> np.ndarray:
    """Records of shingles that at least two nodes have, or that are spread out, each node
    once, by shingle and size."""
    r = r[np.lexsort((r["lo"], r["hi"], r["n"], r["token"]))]
    if len(r) < 2:
        return r[:0]
    same = r["token"][1:] == r["token"][:-1]
    again = same & (r["hi"][1:] == r["hi"][:-1]) & (r["lo"][1:] == r["lo"][:-1]) & (r["n"][1:] == r["n"][:-1])
    r = r[np.concatenate([[True], ~again])]
    same = np.concatenate([[False], r["token"][1:] == r["token"][:-1], [False]])
    return r[same[1:] | same[:-1] | (r["spread"] > 1)]


def _by_node(buckets: int):
    """Of a bucket of shingles: the shared ones' records, dealt out by node."""

    def run(key, table):
        r, docs = _unpacked(table)
        return pa.Table.from_batches([_blobs(_dealt(_shared(r), "hi", buckets) + docs)])

    return run


def _by_shingle(t: int, buckets: int):
    """Of a bucket of nodes: the records of those that share enough, dealt out by shingle."""

    def run(key, table):
        r, docs = _unpacked(table)
        if len(r):
            _, node, count = np.unique(r[["hi", "lo", "n"]], return_inverse=True, return_counts=True)
            # The smallest set that it may link with has the smaller l.
            r = r[count[node.ravel()] >= least_shared(least_overlap(r["n"].astype(np.int64), t))]
        return pa.Table.from_batches([_blobs(_dealt(r, "token", buckets) + docs)])

    return run


def _prefixes(docs: DataFrame, frequency: np.ndarray, k: int, t: int, buckets: int) -> DataFrame:
    """Packed prefix records by bucket of shingle, and packed documents."""
    mask = U64(len(frequency) - 1)
    hot = HOT + 4 * int(frequency.mean())

    def blobs(parts: list, records: list) -> pa.RecordBatch:
        rows = _dealt(np.concatenate(parts), "token", buckets) if parts else []
        d = np.array(records, _DOC)
        rows += [(int(x["lo"][0] % buckets), 1, x.tobytes()) for x in (d[lo : lo + 4096] for lo in range(0, len(d), 4096))]
        return _blobs(rows)

    def run(batches):
        seen: set[tuple[int, int]] = set()
        parts, records, held = [], [], 0
        for b in common.text_slices(batches):
            for doc_id, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), k), strict=True):
                n = len(s)
                hi, lo = _node(s)
                records.append((doc_id or 0, doc_id is not None, n, hi, lo))
                if not n or (hi, lo) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add((hi, lo))
                p = n - int(least_overlap(n, t)) + least_shared(n)
                f = frequency[(s & mask).astype(np.int64)]
                rarest = np.lexsort((s, f))[:p]
                r = np.empty(p, _REC)
                r["token"], r["hi"], r["lo"], r["n"], r["pos"] = s[rarest], hi, lo, n, np.minimum(np.arange(p), 65535)
                r["spread"] = np.where(f[rarest] > hot, np.minimum(1 + f[rarest] // HOT, 65535), 1)
                parts.append(r)
                held += p
            if held > 400_000:
                yield blobs(parts, records)
                parts, records, held = [], [], 0
        if records:
            yield blobs(parts, records)

    return common.map_arrow(docs, run, _BLOB)


_OUT = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("token", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_OUT_SQL = "kind string, doc_id long, token long, hi long, lo long, n int, pos int"


def _members(t: int):
    """Of a bucket of shingles: documents (d), and members of groups within the prefix for l = 1 (g)."""

    def run(key, table):
        r, docs = _unpacked(table)
        d = np.concatenate([np.zeros(0, _DOC), *(np.frombuffer(x, _DOC) for _, _, x in docs)])
        r = r[r["pos"] <= r["n"] - least_overlap(r["n"].astype(np.int64), t)] if len(r) else r
        r = _shared(r)
        out = []
        for kind, x in (("d", d), ("g", r)):
            none = pa.nulls(len(x), pa.int64())
            doc = pa.array(d["doc"], mask=d["known"] == 0) if kind == "d" else none
            token = none if kind == "d" else pa.array(np.ascontiguousarray(r["token"]).view(np.int64))
            pos = pa.nulls(len(x), pa.int32()) if kind == "d" else pa.array(r["pos"].astype(np.int32))
            out.append(pa.RecordBatch.from_arrays([pa.array([kind] * len(x), pa.string()), doc, token, pa.array(np.ascontiguousarray(x["hi"]).view(np.int64)), pa.array(x["lo"].astype(np.int64)), pa.array(x["n"].astype(np.int32)), pos], schema=_OUT))
        return pa.Table.from_batches(out)

    return run


def _sets(docs: DataFrame, wanted: np.ndarray, k: int) -> DataFrame:
    """u, n, bins, grams of every node that the filter lets through, each once."""

    def run(batches):
        pick, seen = common.Bloom(wanted), set()
        for b in common.text_slices(batches):
            found = [(s, *_node(s)) for s in shingle_sets(b.column(1), k) if len(s)]
            if not found:
                continue
            ok = pick.has(np.array([f[1] for f in found], U64))
            found = [f for f, x in zip(found, ok, strict=True) if x and (f[1], f[2]) not in seen]
            fresh = {(f[1], f[2]): f[0] for f in found}
            seen.update(fresh)
            if not fresh:
                continue
            hi, lo = (np.array(x, U64).view(np.int64) for x in zip(*fresh, strict=True))
            n = pa.array([len(x) for x in fresh.values()], pa.int32())
            bins = [np.minimum(np.bincount((s >> U64(56)).astype(np.int64), minlength=BINS), 127).astype(np.int8) for s in fresh.values()]
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), n, pa.array(bins, pa.list_(pa.int8())), pa.array([s.view(np.int64) for s in fresh.values()], pa.list_(pa.int64()))], names=["hi", "lo", "n", "bins", "grams"])

    rows = common.map_arrow(docs, run, "hi long, lo long, n int, bins array<tinyint>, grams array<long>")
    return rows.groupBy(F.struct("hi", "lo", "n").alias("u")).agg(F.first("bins").alias("bins"), F.first("grams").alias("grams"))


def _need(t: int) -> Column:
    """Shared shingles that two sets of these sizes need."""
    return F.ceil(t * (F.col("a_n") + F.col("b_n")) / F.lit(100 + t))


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b, a_n, b_n) that reach the threshold. The suffix filter first: what sets
    differ in the number of hashes of each bin (counted up to 127) cannot be shared."""
    bins = sets.select("u", "bins")
    pairs = pairs.join(bins.select(F.col("u").alias("a"), F.col("bins").alias("a_bins")), "a").join(bins.select(F.col("u").alias("b"), F.col("bins").alias("b_bins")), "b")
    apart = F.aggregate(F.zip_with("a_bins", "b_bins", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda s, x: s + x)
    pairs = pairs.where(apart <= F.col("a_n") + F.col("b_n") - 2 * _need(t)).select("a", "b", "a_n", "b_n")
    grams = sets.select("u", "grams")
    both = pairs.join(grams.select(F.col("u").alias("a"), F.col("grams").alias("a_grams")), "a").join(grams.select(F.col("u").alias("b"), F.col("grams").alias("b_grams")), "b")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    return both.where(100 * shared >= t * (F.col("a_n") + F.col("b_n") - shared)).select("a", "b")


def _small(t: int) -> Column:
    """Whether a node has as much behind a shingle as it would have to share with a set of its
    own size: of a pair, the smaller set does at the first shingle that both have."""
    return F.col("n") - F.col("pos") >= F.ceil(2 * t * F.col("n") / F.lit(100 + t))


def _with_roots(members: DataFrame, roots: DataFrame | None, t: int) -> DataFrame:
    """Members of shingles that two components still share and that a small one has, with
    their roots and the root that most of the shingle's members have (top)."""
    if roots is None:
        known = members.withColumn("root", F.col("u"))
    else:
        known = members.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    each = known.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.max(_small(t)).alias("small"))
    apart = each.groupBy("token").agg(F.count(F.lit(1)).alias("roots"), F.max("small").alias("small"), F.max(F.struct("c", "root")).alias("t")).where("roots > 1 and small").select("token", F.col("t.root").alias("top"))
    return known.join(apart, "token")


def _long_enough(t: int) -> Column:
    return 100 * F.least("a_n", "b_n") >= t * F.greatest("a_n", "b_n")


def _scored(spark: SparkSession, members: DataFrame) -> DataFrame:
    """Adds score: how often a node's shingles are shared. The original of many copies scores
    above them, and links with most."""
    # Stored, so that the join deals both sides out anew and can split a frequent shingle.
    sizes = common.store(spark, members.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "sizes")
    return members.join(members.join(sizes, "token").groupBy("u").agg(F.sum("c").alias("score")), "u")


def _fewest(pairs: DataFrame, t: int) -> DataFrame:
    """A few pairs of each node b, those with the best a first."""
    pairs = pairs.where(_long_enough(t)).distinct()
    few = Window.partitionBy("b").orderBy(F.desc("rank"), "a")
    return pairs.withColumn("k", F.row_number().over(few)).where(F.col("k") <= STAR_PAIRS).select("a", "b", "a_n", "b_n")


def _star_pairs(members: DataFrame, t: int) -> DataFrame:
    """Each group's nodes with those of the best scores in it."""
    best = Window.partitionBy("token").orderBy(F.desc("score"), "u")
    centers = members.withColumn("k", F.row_number().over(best)).where(F.col("k") <= STAR_PAIRS)
    centers = centers.select("token", F.col("u").alias("a"), F.col("n").alias("a_n"), F.col("score").alias("rank"))
    pairs = members.join(centers, "token").where((F.col("rank") > F.col("score")) | ((F.col("rank") == F.col("score")) & (F.col("a") < F.col("u"))))
    return _fewest(pairs.select("a", F.col("u").alias("b"), "a_n", F.col("n").alias("b_n"), "rank"), t)


def _all_pairs(spark: SparkSession, members: DataFrame, roots: DataFrame | None, t: int) -> DataFrame:
    """Every pair of nodes in two components that a shingle of both prefixes, their sizes
    and its places in them let link. What the filters refuse is no row of the join.

    At least one node of a pair is outside the shingle's largest component, so those meet
    all: a component of any size costs its shingles' strays times its size, not its square.
    The smaller set of a pair (small) needs as much behind the shingle as it would have to
    share with a set of its own size, which ends its prefix early."""
    # Stored, so that the joins deal both sides out anew and can split a frequent shingle.
    left = common.store(spark, _with_roots(members, roots, t).select("token", "u", "n", "pos", "root", "top"), "apart")
    stray, small = F.col("root") != F.col("top"), _small(t)
    x, y = (left.select("token", F.col("u").alias(c), F.col("n").alias(f"{c}_n"), F.col("pos").alias(f"{c}_pos"), F.col("root").alias(f"{c}_root"), stray.alias(f"{c}_stray"), small.alias(f"{c}_small")) for c in "ab")
    most = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    fits = (F.col("a_root") != F.col("b_root")) & _long_enough(t) & (most >= _need(t))
    # a is the smaller one, of equal sizes the lesser node; first a stray, then b alone.
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    x = x.where("a_small")
    pairs = x.where("a_stray").join(y, "token").unionByName(x.where("not a_stray").join(y.where("b_stray"), "token"))
    found = common.store(spark, pairs.where(fits & smaller).select("a", "b", "a_n", "b_n").distinct(), "pairs")
    common.discard(spark, left)
    return found


def ngram_join(spark: SparkSession, docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id (the
    smallest doc_id that links of at least threshold / 100 reach)."""
    width = common.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = common.groups(docs, width, GROUP_BYTES)
    frequency = _frequencies(docs, k, SLOTS_LOG2)
    dealt = common.apply_arrow(_prefixes(docs, frequency, k, threshold, buckets), "bucket", _by_node(buckets), _BLOB)
    dealt = common.apply_arrow(dealt, "bucket", _by_shingle(threshold, buckets), _BLOB)
    base = common.store(spark, common.apply_arrow(dealt, "bucket", _members(threshold), _OUT_SQL), "prefixes")
    u = F.struct("hi", "lo", "n").alias("u")
    members = base.where("kind = 'g'").select("token", u, "n", "pos")

    roots = None
    if members.head(1):
        wanted = common.bloom_of(base.where("kind = 'g'"), ["hi"], common.filter_log2(docs, 0.06))
        sets = common.store(spark, _sets(docs, wanted, k), "sets")
        members = common.store(spark, _scored(spark, members), "members")
        links = None
        for first in (True, False):
            pairs = common.store(spark, _star_pairs(members, threshold), "pairs") if first else _all_pairs(spark, members, roots, threshold)
            found = common.store(spark, _verified(pairs, sets, threshold), "links")
            common.discard(spark, pairs)
            if found.head(1):
                links = found if links is None else links.unionByName(found)
                roots = common.store(spark, components(spark, links), "roots")
        common.discard(spark, sets, members)

    own = base.where("kind = 'd'").select("doc_id", F.col("n").cast("long").alias("n_shingles"), u)
    if roots is not None:
        own = own.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    else:
        own = own.withColumn("root", F.col("u"))
    own = common.store(spark, own.drop("u"), "own")
    # Stored, so that the join deals both sides out anew and can split a large component.
    smallest = common.store(spark, own.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    linked = own.where("n_shingles > 0").join(smallest, "root").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(other) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY ALL
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole."""
    return ngram_join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
