"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted
and their ranks are integer names. Adjacent names are then paired, distinct pairs
are sorted and named, and so on: after log2(blocks) rounds one name is left for
each document. Equal (number of blocks, name) means equal text, with no hash that
could collide.

Only the first step moves text. Before that shuffle each task keeps one copy of a
block and a reference for every further one, so a text that fills a third of all
rows reaches a reducer once per task of the scan, never once per row.

Defined results: null text counts as empty; empty texts equal each other; rows
that repeat (equal id and text) are separate rows, exactly one of a group is kept;
a null doc_id is smaller than any other; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalframe.llm import common

BLOCK_BYTES = 4096
#: A task forgets its blocks beyond this and starts over, so its memory is bounded.
TASK_BLOCK_BYTES = 48 << 20

_SCHEMA = "bucket int, block binary, rid long, pos int, rep_rid long, rep_pos int, doc_id long, n_blocks int, text_sha256 string"
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("rid", pa.int64()), ("pos", pa.int32()), ("rep_rid", pa.int64()), ("rep_pos", pa.int32()), ("doc_id", pa.int64()), ("n_blocks", pa.int32()), ("text_sha256", pa.string())])


def _cutter(block_bytes: int, buckets: int):
    import xxhash

    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        seen: dict[bytes, tuple[int, int]] = {}
        held = 0
        for b in common.text_slices(batches):
            out: list[list] = [[] for _ in _ARROW]
            ids = b.column(0).to_pylist()
            data, offsets = common.text_bytes(b.column(1))
            raw = common.lower(data).tobytes()
            for i, doc_id in enumerate(ids):
                text = raw[offsets[i] : offsets[i + 1]]
                sha = hashlib.sha256(text).hexdigest()
                n = max(1, -(-len(text) // block_bytes))
                for pos in range(n):
                    block = text[pos * block_bytes : (pos + 1) * block_bytes]
                    rep = seen.get(block)
                    if rep is None:
                        if held > TASK_BLOCK_BYTES:
                            seen.clear()
                            held = 0
                        seen[block] = rep = (rid, pos)
                        held += len(block) + 150
                        row = (xxhash.xxh3_64_intdigest(block) % buckets, block)
                    else:
                        row = (rid % buckets, None)
                    for column, x in zip(out, (*row, rid, pos, *rep, doc_id, n, sha if pos == 0 else None), strict=True):
                        column.append(x)
                rid += 1
            yield common.batch(_ARROW, *out)

    return run


def _named(pairs: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Sorts distinct keys within buckets of their hash; the rank, with the bucket
    in front, is the name."""
    bucketed = pairs.select(*keys).distinct().withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    return bucketed.select(*keys, (F.col("bucket") * (1 << 40) + rank).alias("name"))


def exact_dedup(spark: SparkSession, docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id (largest doc_id of
    its group), group_size, kept, text_sha256. A-Z count as a-z."""
    width = common.tune(spark)
    buckets = 8 * width
    cut = common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _cutter(block_bytes, buckets), _SCHEMA)
    dealt = cut.repartition(width, "bucket")
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("block"))
    first = common.store(spark, dealt.withColumn("name", F.when(F.col("block").isNotNull(), F.col("bucket").cast("long") * (1 << 40) + rank)).drop("block", "bucket"), "blocks")

    reps = first.where("name is not null").select(F.col("rid").alias("rep_rid"), F.col("pos").alias("rep_pos"), "name")
    own = first.where("name is not null").select("rid", "pos", "n_blocks", "name")
    referred = first.where("name is null").drop("name").join(reps, ["rep_rid", "rep_pos"]).select("rid", "pos", "n_blocks", "name")
    names = own.unionByName(referred)
    longest = first.agg(F.max("n_blocks")).first()[0] or 1

    done, active = names.where("n_blocks = 1").select("rid", "n_blocks", "name"), names.where("n_blocks > 1")
    if longest > 1:
        active = common.store(spark, active, "names")
    step = 1
    while longest > 1:
        step *= 2
        half = (F.col("pos") / 2).cast("int")
        pairs = active.groupBy("rid", "n_blocks", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            # The last name of an odd row has no partner.
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = common.store(spark, pairs, "pairs")
        active = pairs.join(_named(pairs, ["a", "b"], buckets), ["a", "b"]).select("rid", "pos", "n_blocks", "name")
        active = common.store(spark, active, "names")
        longest = -(-longest // 2)
        if longest > 1:
            # What has one name left is complete: it stood at position 0 alone.
            active, ended = active.where(F.col("n_blocks") > step), active.where(F.col("n_blocks") <= step)
        else:
            ended = active
        done = done.unionByName(ended.select("rid", "n_blocks", "name"))

    heads = first.where("pos = 0").select("rid", "doc_id", "text_sha256")
    named = common.store(spark, heads.join(done, "rid"), "identity")
    groups = named.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("top"))
    # Stored, so that the join deals both sides out anew and can split a large group.
    groups = common.store(spark, groups, "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("top.rid")).alias("kept"),
        "text_sha256",
    )


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of all documents; of equal ones the row with the largest doc_id stays."""
    return exact_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
