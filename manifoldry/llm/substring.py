"""Substring dedup by difference-cover anchors.

Two equal windows of `window` words at any two places agree, at some common shift below `period`, on an aligned anchor: the
positions whose remainders modulo the period lie in a difference cover hold one such pair for every difference. So
it is enough to hash the short anchors at cover positions only (about a quarter of all), to find the anchor hashes that occur
twice, and to extend around those to whole windows, which are then compared by 128-bit hashes. Both comparisons are
exchanges of sorted, already combined hashes of a block of documents; a group of copies gives one entry a block, no pairs. A block sends a
message to each bucket that it has hashes for: never more messages than hashes, so they grow with the data whatever the numbers of blocks and buckets,
and what a block gets back is a bit for each of its own hashes at most. A bucket has about BUCKET_KEYS hashes, plus one a block for a window that all blocks hold.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FAMILIES, U64, bytes_of, scratch_path, word_hashes, word_spans

#: A difference cover of the integers modulo 21: every remainder is a difference of two of its members.
COVER = (0, 1, 6, 8, 18)
PERIOD = 21
WINDOW = 35
#: Raw bytes of text in a block, and hashes that one reducing task holds at a time.
BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1_000_000

RESULT = "doc_id long, text string, n_words long, n_removed long, removed_from array<int>, removed_to array<int>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: one row with a compressed Arrow stream of doc_id and text."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([(part << 33) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    for batch in batches:
        _, at = bytes_of(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES - size, side="right")) - 1)
            hi = min(hi, batch.num_rows)
            held.append(batch.slice(lo, hi - lo))
            size += int(at[hi] - at[lo])
            if size >= BLOCK_BYTES * 0.9:
                yield block()
                held, size, number = [], 0, number + 1
            lo = hi
    if held:
        yield block()


class _Block:
    """The words of a block, with the hashes of any windows in it."""

    def __init__(self, payload: bytes):
        self.table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.data, self.offsets = bytes_of(self.table.column(1))
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets)
        self.n = len(self.starts)
        words = np.diff(self.first)
        self.place = np.arange(self.n) - np.repeat(self.first[:-1], words)
        self.left = np.repeat(self.first[1:], words) - np.arange(self.n)
        self._words: dict[int, np.ndarray] = {}

    def windows(self, at: np.ndarray, length: int, family: int) -> np.ndarray:
        f = FAMILIES[family]
        if family not in self._words:
            self._words[family] = word_hashes(self.data, self.starts, self.ends, f)
        return f.spans(self._words[family], at, at + length)


def _bucket(high: np.ndarray, buckets: int) -> np.ndarray:
    return ((high >> U64(32)) * U64(buckets)) >> U64(32)


def _anchors(b: _Block, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors; then their distinct hashes in order, which of these each has, and how often each occurs."""
    aligned = np.zeros(period, dtype=bool)
    aligned[list(cover)] = True
    length = window - period + 1
    # a document of fewer words than a window has no window, and so no anchor that could matter
    at = np.flatnonzero(aligned[b.place % period] & (b.left >= length) & (b.place + b.left >= window))
    keys, which, times = np.unique(b.windows(at, length, 0), return_inverse=True, return_counts=True)
    return at, keys[:, None], which, times


def _candidates(b: _Block, repeated: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that hold a repeated anchor; then as for _anchors, with 128-bit hashes."""
    edge = np.zeros(b.n + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(repeated - (period - 1), repeated - b.place[repeated]), 1)
    np.add.at(edge, repeated + 1, -1)
    at = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (b.left >= window))
    pair = np.stack([b.windows(at, window, 0), b.windows(at, window, 1)], axis=1)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (pair[order[1:]] != pair[order[:-1]]).any(axis=1)
    which = np.empty(len(at), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return at, pair[order[new]], which, np.bincount(which, minlength=int(new.sum()))


def _repeated(keys: np.ndarray, masks: list | None, buckets: int) -> np.ndarray:
    """Which distinct hashes of a block the exchange found twice."""
    out = np.zeros(len(keys), dtype=bool)
    edges = np.searchsorted(_bucket(keys[:, 0], buckets), np.arange(buckets + 1, dtype=U64)) if len(keys) else np.zeros(buckets + 1, dtype=int)
    for m in masks or ():
        lo, hi = edges[m["bucket"]], edges[m["bucket"] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(m["mask"], dtype=np.uint8), count=hi - lo).astype(bool)
    return out


def _send(block: int, keys: np.ndarray, times: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct hashes, cut by bucket."""
    edges = np.searchsorted(_bucket(keys[:, 0], buckets), np.arange(buckets + 1, dtype=U64)) if len(keys) else np.zeros(buckets + 1, dtype=int)
    to = [i for i in range(buckets) if edges[i + 1] > edges[i]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(to, pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array([keys[edges[i] : edges[i + 1]].tobytes() for i in to], pa.binary()), pa.array([np.packbits(times[edges[i] : edges[i + 1]] > 1).tobytes() for i in to], pa.binary())],
        names=["bucket", "block", "hashes", "twice"],
    )


def _meet(width: int):
    """One bucket's reducer: a hash counts as repeated if two blocks send it, or one block has it twice."""

    def meet(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_buffer(), dtype=U64).reshape(-1, width) for x in table.column("hashes").combine_chunks()]
        sizes = [len(x) for x in rows]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), dtype=np.uint8), count=n) for x, n in zip(table.column("twice").combine_chunks(), sizes)]).astype(bool)
        keys = np.concatenate(rows)
        order = np.argsort(keys[:, 0]) if width == 1 else np.lexsort((keys[:, 1], keys[:, 0]))
        keys = keys[order]
        same = (keys[1:] == keys[:-1]).all(axis=1)
        hit = np.zeros(len(keys), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        twice[order] |= hit
        ends = np.cumsum(sizes)
        found = [twice[e - n : e] for e, n in zip(ends, sizes)]
        keep = [i for i, x in enumerate(found) if x.any()]
        return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())), "bucket": table.column("bucket").take(pa.array(keep, pa.int64())), "mask": pa.array([np.packbits(found[i]).tobytes() for i in keep], pa.binary())})

    return meet


def _masks(sent: DataFrame, width: int, name: str) -> DataFrame:
    met = sent.groupBy("bucket").applyInArrow(_meet(width), "block long, bucket int, mask binary")
    return met.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias(name))


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of `window` consecutive words whose word sequence also starts anywhere else.

    Words are runs of bytes other than 20 and 09-0D (hex). Windows are judged on the input, so all occurrences go.
    Returns doc_id, text (the kept words joined by one space), n_words, n_removed, removed_from, removed_to (word positions).

    Null text: no words, empty text. Empty text and texts under `window` words: nothing removed. Null doc_id: kept as null; rows are told apart by place,
    not by id. Repeated rows: each is an occurrence, so their windows repeat. Other columns are not read, whatever their names. Empty table: empty result.
    """
    if not 0 < period < window or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover must hold every difference modulo a period that is shorter than the window")
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # the blocks are written once, bucketed: each later pass joins them with a few bits a block and shuffles no text
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name, path = f"blocks_{uuid.uuid4().hex}", scratch_path(spark, "blocks")
    docs.mapInArrow(_pack, "block long, payload binary").write.format("parquet").option("compression", "none").option("path", path).bucketBy(parts, "block").saveAsTable(name)
    blocks = spark.table(name)
    # the plan knows its files and buckets by now, and the catalog has nothing to keep: dropping an external table leaves its files
    spark.sql(f"DROP TABLE {name}")
    n_blocks = blocks.count()
    buckets = max(parts, math.ceil(n_blocks * BLOCK_BYTES / 6 * len(cover) / period / BUCKET_KEYS))

    def anchors(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                _, keys, _, times = _anchors(_Block(payload.as_buffer()), window, period, cover)
                yield from _send(block, keys, times, buckets)

    sent = "bucket int, block long, hashes binary, twice binary"
    first = _masks(blocks.mapInArrow(anchors, sent), 1, "anchors")

    def around(payload, masks):
        b = _Block(payload)
        at, keys, which, _ = _anchors(b, window, period, cover)
        return b, _candidates(b, at[_repeated(keys, masks, buckets)[which]], window, period)

    def windows(batches):
        for batch in batches:
            for block, payload, masks in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("anchors").to_pylist()):
                if masks:
                    _, (_, keys, _, times) = around(payload.as_buffer(), masks)
                    yield from _send(block, keys, times, buckets)

    anchored = spark.read.schema(first.schema).parquet(_write(first, scratch_path(spark, "anchors")))
    with_anchors = blocks.join(anchored.hint("shuffle_hash"), "block", "left")
    second = _masks(with_anchors.mapInArrow(windows, sent), 2, "windows")

    def finish(batches):
        for batch in batches:
            for payload, masks, found in zip(batch.column("payload"), batch.column("anchors").to_pylist(), batch.column("windows").to_pylist()):
                b, (at, keys, which, _) = around(payload.as_buffer(), masks)
                edge = np.zeros(b.n + 1, dtype=np.int64)
                hit = at[_repeated(keys, found, buckets)[which]]
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                yield _result(b, np.cumsum(edge)[:-1] > 0)

    return with_anchors.join(second.hint("shuffle_hash"), "block", "left").select("payload", "anchors", "windows").mapInArrow(finish, RESULT)


def _write(df: DataFrame, path: str) -> str:
    df.write.option("compression", "zstd").parquet(path)
    return path


def _result(b: _Block, gone: np.ndarray) -> pa.RecordBatch:
    texts, froms, tos, removed = [], [], [], []
    raw = b.data.tobytes()
    for i in range(len(b.offsets) - 1):
        words = raw[b.offsets[i] : b.offsets[i + 1]].split()
        mask = gone[b.first[i] : b.first[i + 1]]
        n = int(mask.sum())
        removed.append(n)
        if n:
            step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
            froms.append(np.flatnonzero(step == 1).tolist())
            tos.append(np.flatnonzero(step == -1).tolist())
            words = compress(words, (~mask).tolist())
        else:
            froms.append([])
            tos.append([])
        texts.append(b" ".join(words))
    return pa.RecordBatch.from_arrays(
        [b.table.column(0).combine_chunks(), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(b.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(froms, pa.list_(pa.int32())), pa.array(tos, pa.list_(pa.int32()))],
        names=["doc_id", "text", "n_words", "n_removed", "removed_from", "removed_to"],
    )
