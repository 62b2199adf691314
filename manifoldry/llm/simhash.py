"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight (position, byte) postings. Two fingerprints that differ in at most two bits differ in at most two
bytes, so they share at least six postings. The index is keyed by every choice of six positions with their bytes: a pair meets in
it exactly if its count of shared postings reaches that minimum, which is the count filter; fewer shared postings never meet. A posting list then holds distinct fingerprints that differ in
two known bytes only, so it never has more than 65,536 members, however many documents are copies. In a list, members are linked through
the values one bit away from them: two members share such a value exactly if they differ in at most two bits. Each value links its
members to the least one, so links grow with members and not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COLD, U64, bytes_of, cut, drop_scratch, join_by_counts

SHINGLE = 3
SEED = 42
BITS = 2
#: Every choice of six of the eight byte positions, as the two positions left open.
OPEN = tuple(combinations(range(8), 2))

_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes, repeats included. ASCII letters are lower-cased; no word: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), dtype=U64, count=n - SHINGLE + 1)
    counts = np.zeros(2048, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.bincount((hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048)
    ones = np.einsum("pb,bk->pk", counts.reshape(8, 256), _BITS_OF).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_keys: bool = False) -> DataFrame:
    """doc_id and its 64-bit fingerprint (as a signed long) of every row; null text counts as empty, with fingerprint 0. with_keys: a and b too, 128 bits of hash of id and text."""
    extra = ["a", "b"] if with_keys else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column(0))
            raw = memoryview(data)
            found = np.fromiter((fingerprint(bytes(raw[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), dtype=U64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names=["doc_id", *extra, "fp"])

    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keys = [F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), i, t).alias("b")] if with_keys else []
    return docs.select(t.alias("text"), i.cast("long").alias("doc_id"), *keys).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *extra, "fp")))


def _mask(a: int, b: int) -> int:
    """All bits but those of bytes a and b, as a signed 64-bit integer."""
    m = ((1 << 64) - 1) & ~((255 << 8 * a) | (255 << 8 * b))
    return m - (1 << 64) if m >> 63 else m


def _links(choice: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links inside whole posting lists that stand together, ordered by list: pairs (larger, smaller) of fingerprints."""
    a, b = (np.array([o[i] for o in OPEN], dtype=U64)[choice] * U64(8) for i in (0, 1))
    rest = fp & ~((U64(255) << a) | (U64(255) << b))
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (rest[1:] != rest[:-1]) | (choice[1:] != choice[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    if not many.any():
        return np.zeros((0, 2), dtype=U64)
    fp, group, a, b = fp[many], group[many], a[many], b[many]
    value = (((fp >> a) & U64(255)) | (((fp >> b) & U64(255)) << U64(8))).astype(np.int64)
    near = np.concatenate([value[None], value[None] ^ (1 << np.arange(16, dtype=np.int64))[:, None]])
    key = (group[None] * 65536 + near).ravel()
    who = np.tile(fp, 17)
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    least = who[first][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([who, least], axis=1)[who != least], axis=0)
    x = pairs[:, 0] ^ pairs[:, 1]
    return pairs[np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) <= BITS]


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a and b distinct fingerprints, whose components are those of the relation "differ in at most two bits".

    distinct: one row a fingerprint, in a column fp.
    """
    index = distinct.select(F.explode(F.array([F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(*o)).cast("long")).alias("rest")) for i, o in enumerate(OPEN)])).alias("k"), "fp").select("k.choice", "k.rest", "fp")
    dealt = index.repartition("choice", "rest").sortWithinPartitions("choice", "rest").drop("rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        seen = np.zeros((0, 2), dtype=U64)

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            c = np.concatenate([held_c, batch.column(0).to_numpy().astype(np.int64)])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(U64)])
            if not len(c):
                continue
            # the last list may go on in the next batch; it has 65,536 members at most
            a, b = OPEN[c[-1]]
            rest = ~((U64(255) << U64(8 * a)) | (U64(255) << U64(8 * b)))
            other = np.flatnonzero((c != c[-1]) | ((f & rest) != (f[-1] & rest)))
            cutoff = int(other[-1]) + 1 if len(other) else 0
            seen = np.unique(np.concatenate([seen, _links(c[:cutoff], f[:cutoff])]), axis=0)
            held_c, held_f = c[cutoff:], f[cutoff:]
            if len(seen) > 100_000:
                yield out(seen)
                seen = seen[:0]
        if len(held_c):
            seen = np.unique(np.concatenate([seen, _links(held_c, held_f)]), axis=0)
        if len(seen):
            yield out(seen)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The connected components of edges (a, b), as (node, root) with the least node as root; only nodes that have an edge.

    Large star and small star in turns (Kiveris and others, 2014): each turn joins neighbours to the least one they know. Every turn's
    edges are written to the shared folder. A node with a large part of all edges is dealt to many tasks.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        # so few edges that no node can be hot are joined as they are
        joined = (lambda left, least: left.join(least, "a")) if 2 * mark[0] < COLD else (lambda left, least: join_by_counts(left, cut(least, "least"), ["a"], "n", by="b"))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        was, now = now, cut(small, "edges")
        drop_scratch(now.sparkSession, was)


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_keys: bool = False) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included) and root (the component's least fp) of every row of docs.

    Null and empty texts, and texts without a word, have fingerprint 0 and link like any other. A row of null doc_id takes part in links; a
    component without any doc_id has component_id null. Repeated rows come back as often. Other columns are not read. Empty table: empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col, with_keys), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp")))
    root = F.coalesce("root", "fp").alias("root")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", root)
    of_root = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "roots")
    named = cut(join_by_counts(rooted, of_root, ["root"], "members", by="fp").select("fp", "n", "component_id", "root"), "components")
    # copies of one text may be a third of all rows: their fingerprint is dealt to many tasks
    return join_by_counts(marked, named, ["fp"], "n", by="doc_id").select("doc_id", *(["a", "b"] if with_keys else []), "fp", "component_id", "root")
