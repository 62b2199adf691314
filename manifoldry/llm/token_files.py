"""Token ids in Arrow files of fixed-size-list batches.

A file holds rows of `length` ids and as many mask bits; all rows are equally long, so any sequence and its mask are slices of a memory map without a copy. Ids take
16 bits, or 32 with a vocabulary of over SMALL. Documents
follow each other in ascending order of id; only a file's last row is padded, with mask false. A second Arrow file beside each lists its documents and their lengths.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FAMILIES, LOWER, SEPARATOR, U64, bytes_of, slices, splitmix, trim, word_hashes

LENGTH, ROWS = 2048, 128
SMALL = 1 << 16
#: Distinct words that a worker remembers, and bytes of text that it takes at a time.
REMEMBERED, PART = 400_000, 4 << 20


#: Kinds of bytes: white space, ASCII letters, digits, other ASCII signs; and those that may belong to what stands beside them: an apostrophe, the signs of
#: special tokens, control characters, and longer characters.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[39, 60, 62, 124]] = 4
_KIND[SEPARATOR] = 0


class WordEncoder:
    """Ids of whole texts, by way of their distinct pieces: runs of letters, digits or signs. For a tokenizer that drops white space and case, and never joins these."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= SMALL else np.uint32)
        # words known by 128 bits of hash, in order of the first 64; where their ids are in the pool, the oldest first
        self.keys, self.others, self.place, self.size = np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=self.dtype)
        probe = "It's  a\tTEST,\nof words'll\r\n(and) 12345 \u00c9t\u00e9s!? x2y <|endoftext|> $%a,b.c".encode()
        whole = self.tokenizer.encode(probe.decode(), add_special_tokens=False).ids
        if whole != self.encode(np.frombuffer(probe, dtype=np.uint8), np.array([0, len(probe)]))[0].tolist():
            raise ValueError("this tokenizer's words aren't independent")

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each row's first id (n + 1 values)."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        data, offsets = data[lo:hi], offsets - lo
        if not len(data):
            return np.zeros(0, dtype=self.dtype), np.zeros(len(offsets), dtype=np.int64)
        if b"<|" not in data.tobytes():  # special tokens know case
            data = LOWER[data]
        kind = _KIND[data]
        inside = kind > 0
        begin = inside.copy()
        begin[1:] &= (kind[1:] != kind[:-1]) & (((kind[1:] < 4) & (kind[:-1] < 4)) | (kind[:-1] == 0))
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        begin[heads] = inside[heads]
        stop = inside.copy()
        stop[:-1] &= begin[1:] | ~inside[1:]
        stop[heads[1:] - 1] = inside[heads[1:] - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if not len(starts):
            return np.zeros(0, dtype=self.dtype), np.zeros(len(offsets), dtype=np.int64)
        first = np.searchsorted(starts, offsets)
        one, two = (word_hashes(data, starts, ends, f) for f in FAMILIES)
        keys, at, which = np.unique(one, return_index=True, return_inverse=True)
        while (two != two[at][which]).any():
            # two words share a 64-bit hash: go on with another
            one = splitmix(one + two)
            keys, at, which = np.unique(one, return_index=True, return_inverse=True)
        place, size = self._ids_of(data.tobytes(), keys, two[at], starts[at], ends[at])
        n = size[which]
        total = np.cumsum(n)
        ids = self.pool[np.repeat(place[which] - (total - n), n) + np.arange(int(total[-1]))]
        self._forget()
        return ids, np.concatenate([[0], total])[first]

    def _ids_of(self, raw: bytes, keys: np.ndarray, others: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each distinct word's ids in the pool; words that aren't known go through the tokenizer and are added to it. keys: ascending."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == keys) & (self.others[at] == others) if len(self.keys) else np.zeros(len(keys), dtype=bool)
        place, size = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        place[hit], size[hit] = self.place[at[hit]], self.size[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            found = [e.ids for e in self.tokenizer.encode_batch([raw[a:b].decode(errors="replace") for a, b in zip(starts[new].tolist(), ends[new].tolist())], add_special_tokens=False)]
            size[new] = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            place[new] = len(self.pool) + np.cumsum(size[new]) - size[new]
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), dtype=self.dtype, count=int(size[new].sum()))])
            into = np.searchsorted(self.keys, keys[new])
            self.keys, self.others, self.place, self.size = (np.insert(x, into, y[new]) for x, y in ((self.keys, keys), (self.others, others), (self.place, place), (self.size, size)))
        return place, size

    def _forget(self) -> None:
        """Keep the older half of too many words: frequent words came early."""
        if len(self.keys) <= REMEMBERED:
            return
        keep = self.place < np.sort(self.place)[REMEMBERED // 2]
        self.keys, self.others, self.place, self.size = (x[keep] for x in (self.keys, self.others, self.place, self.size))
        self.pool = self.pool[: int((self.place + self.size).max(initial=0))].copy()


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str) -> WordEncoder:
    return WordEncoder(tokenizer_json)


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


class _Writer:
    """One file of sequences and one of documents, under a name of this attempt until both are whole."""

    def __init__(self, folder: str, part: int, length: int, dtype: np.dtype):
        self.fs, root = _open(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = [f"{root}/{kind}-{part:06d}.arrow" for kind in ("sequences", "documents")]
        self.tried = [f"{x}.{TaskContext.get().taskAttemptId()}.tmp" for x in self.final]
        self.length = length
        self.sequence = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.document = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = [self.fs.open_output_stream(x) for x in self.tried]
        self.out = [pa.ipc.new_file(s, t) for s, t in zip(self.streams, (self.sequence, self.document))]
        self.rest = np.zeros(0, dtype=dtype)
        self.docs = self.tokens = 0

    def _rows(self, ids: np.ndarray, mask: np.ndarray) -> None:
        for lo in range(0, len(ids), ROWS * self.length):
            x, m = ids[lo : lo + ROWS * self.length], mask[lo : lo + ROWS * self.length]
            self.out[0].write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length), pa.FixedSizeListArray.from_arrays(pa.array(m), self.length)], schema=self.sequence))

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.out[1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64())], schema=self.document))
        self.docs += len(doc_ids)
        self.tokens += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // (ROWS * self.length) * (ROWS * self.length)
        self._rows(ids[:whole], np.ones(whole, dtype=bool))
        self.rest = ids[whole:].copy()

    def close(self) -> None:
        n = len(self.rest)
        if n:
            full = -(-n // self.length) * self.length
            self._rows(np.concatenate([self.rest, np.zeros(full - n, dtype=self.rest.dtype)]), np.arange(full) < n)
        for x in (*self.out, *self.streams):
            x.close()
        for a, b in zip(self.tried, self.final):
            self.fs.move(a, b)


def write_tokens(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Encode every whole text, append end_id, write the ids to files under folder (a URI that all executors reach) in ascending order of id.

    Returns one row a file: part, n_docs, n_tokens, and start, the ids in all files before it. Null and empty texts are one end_id. Null ids come first.
    Repeated ids stand together, ordered by a hash of their texts. Long texts are encoded whole. Other columns are not read. Empty table: no file.
    """
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = encoder = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = _encoder(tokenizer.value)
                out = _Writer(folder, part, length, encoder.dtype)
            data, at = bytes_of(batch.column(1))
            for lo, hi in slices(at, PART):
                ids, first = encoder.encode(data, at[lo : hi + 1])
                out.add(batch.column(0).slice(lo, hi - lo), np.diff(first) + 1, np.insert(ids, first[1:], end_id))
        if out is not None:
            out.close()
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.docs], pa.int64()), pa.array([out.tokens], pa.int64())], names=["part", "n_docs", "n_tokens"])

    # one small row a file: its number follows the partitions, not the documents
    rows = sorted(ranged.mapInArrow(run, "part int, n_docs long, n_tokens long").collect())
    starts = np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])]).astype(int).tolist()
    return spark.createDataFrame([(r.part, r.n_docs, r.n_tokens, s) for r, s in zip(rows, starts)], "part int, n_docs long, n_tokens long, start long")


def sequences(folder: str, part: int, first: int, n: int = 1) -> tuple[np.ndarray, pa.BooleanArray]:
    """Sequences first to first + n of a file (within one batch of ROWS), without a copy from a local file: ids, a row a sequence, and all their mask bits, one sequence after another, as an Arrow array."""
    fs, root = _open(folder)
    path = f"{root}/sequences-{part:06d}.arrow"
    source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(first // ROWS)
    ids, mask = batch.column(0), batch.column(1)
    length, lo = ids.type.list_size, first % ROWS
    return ids.flatten().to_numpy()[lo * length : (lo + n) * length].reshape(-1, length), mask.slice(lo, n).flatten()


def read_documents(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit integers) of every document in the files that write_tokens listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, root = _open(folder)
                local = isinstance(fs, pyarrow.fs.LocalFileSystem)
                seq, doc = (pa.ipc.open_file(pa.memory_map(f"{root}/{x}-{part:06d}.arrow") if local else fs.open_input_file(f"{root}/{x}-{part:06d}.arrow")) for x in ("sequences", "documents"))
                rest, at, n = np.zeros(0, dtype="<u4"), 0, 0
                for i in range(doc.num_record_batches):
                    listed = doc.get_batch(i)
                    sizes = listed.column(1).to_numpy()
                    ends = np.cumsum(sizes)
                    held = [rest]
                    n = len(rest)
                    while len(sizes) and n < ends[-1]:
                        x = seq.get_batch(at)
                        # only the end of the last row is padded
                        ids, kept = x.column(0).flatten().to_numpy(), x.column(1).flatten().true_count
                        held.append(ids[:kept].astype("<u4"))
                        n += len(held[-1])
                        at += 1
                    ids = np.concatenate(held)
                    rest = ids[ends[-1] :] if len(ends) else ids
                    raw = [ids[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist())]
                    yield pa.RecordBatch.from_arrays([listed.column(0), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    start += int(ends[-1]) if len(ends) else 0

    n = max(1, files.count())
    return files.select("part", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
