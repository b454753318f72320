"""Bounded-space online packing of token sequences.

Each task tokenises its documents and keeps `OPEN_WINDOWS` open windows. A
document's full windows leave at once; its rest goes to the open window that it
fills best. When it fits nowhere the fullest window is emitted: with the gap it
has if that is at most `MAX_GAP` tokens, else filled with the head of the rest,
which is cut there. What is still open at the end of a task carries its ids along
and is packed again, `FAN_IN` tasks at a time, until one group is left; that group
fills its windows to the brim. No step sees more than FAN_IN * OPEN_WINDOWS windows.

Defined results: null text is empty and has the closing id alone; a null doc_id is
kept; rows that repeat are packed each; extra columns are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.llm import common

WINDOW = 2048
OPEN_WINDOWS = 64
MAX_GAP = 16
FAN_IN = 32
END_ID = 1
#: Bytes that distinct pieces and their ids may take, as far as a task remembers them.
CACHE_BYTES = 48 << 20
#: Bytes of text that are encoded at a time: what is known is looked up once for each such slice.
SLICE_BYTES = 4 << 20
#: Bytes of new pieces that are encoded as one text.
JOINED_BYTES = 64 << 10

_BREAKS = np.zeros(256, bool)
_BREAKS[[0x20, *range(0x09, 0x0E)]] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0x9A, 0x80, 0x81]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT &= ~_ALNUM


class TextEncoder:
    """Ids of whole texts. A byte-level BPE never joins what lies on both sides of a
    space that follows a non-space, or of the start of punctuation after an ASCII
    letter or digit, so texts are cut there and every distinct piece is encoded once.
    A tokenizer's added tokens are looked for before all else: each is a piece of its own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("added tokens that take more or less than their own text are not supported")
        # At one place the longest counts.
        contents = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None

        # Every character of a byte-level token stands for one byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        """Known pieces, the ids of all of them, and how many each has."""
        self.known, self.ids, self.sizes = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _remember(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, pieces])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _one_by_one(self, pieces: pa.Array) -> None:
        texts = pieces.to_pylist()
        for lo in range(0, len(texts), 20_000):
            found = self.tokenizer.encode_batch_fast([x.decode() for x in texts[lo : lo + 20_000]], add_special_tokens=False)
            ids = [np.array(x.ids, np.uint32) for x in found]
            self._remember(pieces.slice(lo, len(ids)), np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Remembers new pieces; their places among the known ones."""
        data, offsets = common.text_bytes(pieces)
        plain = (data[offsets[:-1]] == 0x20) & (data[offsets[1:] - 1] < 0x80) & ~_BREAKS[data[offsets[1:] - 1]]
        place = np.where(plain, np.cumsum(plain), int(plain.sum()) + np.cumsum(~plain)) - 1 + len(self.known)
        if plain.any():
            self._joined(pieces.filter(pa.array(plain)))
        if not plain.all():
            self._one_by_one(pieces.filter(pa.array(~plain)))
        return place

    def _joined(self, pieces: pa.Array) -> None:
        """Pieces that start with a space and end with something else can follow one another
        in a text without being joined, so many of them are encoded as one; where one ends is
        told by the bytes of the tokens."""
        data, offsets = common.text_bytes(pieces)
        raw, ends = data.tobytes(), offsets[1:]
        cuts = np.unique(np.concatenate([[0], ends[np.searchsorted(ends, np.arange(JOINED_BYTES, len(raw), JOINED_BYTES))], [len(raw)]]))
        found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        done = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(done, ends, side="left")
        if done[-1] != len(raw) or (done[last] != ends).any():
            # An added token across pieces, or a tokenizer that is no byte-level one.
            self._one_by_one(pieces)
        else:
            self._remember(pieces, ids, np.diff(last + 1, prepend=0))

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        cut = data == 0x20
        cut[1:] &= ~_BREAKS[data[:-1]]
        # Not after what may be a space beyond ASCII, by its last bytes but one.
        cut[2:] &= ~(_WIDE[data[:-2]] & (data[1:-1] >= 0x80))
        cut[1:] |= _PUNCT[data[1:]] & _ALNUM[data[:-1]]
        if self.added is not None:
            raw = data.tobytes()
            if self.added.search(raw):
                for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                    for m in self.added.finditer(raw, a, b):
                        cut[m.start() : m.end()] = False
                        cut[m.start()] = True
                        if m.end() < len(cut):
                            cut[m.end()] = True
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each row's first (one more than rows)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        s = self._cuts(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(s, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        if self.known.nbytes + self.ids.nbytes + self.sizes.nbytes > CACHE_BYTES:
            self.forget()
        distinct = pieces.dictionary
        at = pc.index_in(distinct, self.known)
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            place[new] = self._learn(distinct.filter(pa.array(new)))
        place = place[pieces.indices.to_numpy()]
        head, n = (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place]
        first = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(head - first[:-1], n) + np.arange(first[-1])]
        return ids, first[np.searchsorted(s, offsets)]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each worker process and file; what it remembers is one task's."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


class Packer:
    """Open windows: lists of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, max_gap: int):
        self.window, self.most, self.max_gap = window, open_windows, max_gap
        self.gaps: list[tuple[int, int]] = []  # (gap, window), sorted
        self.open: dict[int, list] = {}
        self.next = 0

    def add(self, piece: tuple) -> list[list]:
        """Places a piece; returns the windows that are emitted."""
        doc_id, start, ids, total = piece
        out = []
        while len(ids) >= self.window:
            out.append([(doc_id, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                gap, w = self.gaps.pop(at)
                self.open[w].append((doc_id, start, ids, total))
                if gap == len(ids):
                    out.append(self.open.pop(w))
                else:
                    insort(self.gaps, (gap - len(ids), w))
                break
            if len(self.gaps) >= self.most:
                gap, w = self.gaps.pop(0)
                full = self.open.pop(w)
                if gap > self.max_gap:
                    full.append((doc_id, start, ids[:gap], total))
                    start, ids = start + gap, ids[gap:]
                out.append(full)
                continue
            self.open[self.next] = [(doc_id, start, ids, total)]
            insort(self.gaps, (self.window - len(ids), self.next))
            self.next += 1
            break
        return out

    def rest(self) -> list[list]:
        return [self.open[w] for _, w in self.gaps]

    def brim(self) -> list[list]:
        """The open windows' pieces, cut so that all but the last window are full."""
        out, now, free = [], [], self.window
        for doc_id, start, ids, total in (p for w in self.rest() for p in w):
            while len(ids):
                part = ids[:free]
                now.append((doc_id, start, part, total))
                start, ids, free = start + len(part), ids[free:], free - len(part)
                if not free:
                    out.append(now)
                    now, free = [], self.window
        return [*out, now] if now else out


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int32())])


def _rows(windows: list[list], tag: int, part: int, emitted: bool, keep_ids: bool) -> pa.RecordBatch:
    """Rows of windows, numbered from tag on. part is null once a window is emitted."""
    out: list[list] = [[] for _ in _ARROW]
    for k, pieces in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(raw), total, tag + k, offset, raw if keep_ids or not emitted else None, None if emitted else part)
            for column, x in zip(out, row, strict=True):
                column.append(x)
            offset += len(ids)
    return common.batch(_ARROW, *out)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_gap: int = MAX_GAP, fan_in: int = FAN_IN, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of docs (doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset; with keep_ids also ids (little-endian, 32 bits each)."""
    common.tune(spark)

    def first(batches):
        part = TaskContext.get().partitionId()
        packer, tag = Packer(window, open_windows, max_gap), part << 32
        own = encoder(tokenizer_path)
        try:
            for b in common.text_slices(batches, SLICE_BYTES):
                data, offsets = common.text_bytes(b.column(1))
                ids, at = own.encode(data, offsets)
                done = []
                for i, doc_id in enumerate(b.column(0).to_pylist()):
                    whole = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID))
                    done += packer.add((doc_id, 0, whole, len(whole)))
                yield _rows(done, tag, part, True, keep_ids)
                tag += len(done)
        finally:
            own.forget()
        # Slices of a batch's ids must not keep the batch alive.
        yield _rows(packer.rest(), tag, part, False, keep_ids)

    def merge(level: int, last: bool):
        def run(key, table):
            part = key[0].as_py()
            table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            packer, done = Packer(window, open_windows, max_gap), []
            for r in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
                done += packer.add((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
            tag = level << 56 | part << 32
            done += packer.brim() if last else []
            batches = [_rows(done, tag, part, True, keep_ids), _rows([] if last else packer.rest(), tag + len(done), part, False, keep_ids)]
            return pa.Table.from_batches(batches)

        return run

    mapped = common.store(spark, common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), first, _SCHEMA), "packed")
    result, level = mapped.where("part is null"), 1
    open_rows = mapped.where("part is not null")
    parts = (open_rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // fan_in)
        group = (F.col("part") / fan_in).cast("int")
        step = common.apply_arrow(open_rows.withColumn("grp", group), "grp", merge(level, parts == 1), _SCHEMA)
        if parts == 1:
            result = result.unionByName(step)
            break
        step = common.store(spark, step, "packed")
        result, open_rows, level = result.unionByName(step.where("part is null")), step.where("part is not null"), level + 1
    return result.drop("part") if keep_ids else result.drop("part", "ids")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in windows of 2,048 tokens."""
    import public_tokenizers

    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
