"""SimHash near-dedup's other form, for near copies by the Jaccard similarity of their word shingles.

A byte-position index has a guaranteed minimum of shared bytes only while fewer than one bit in eight differs. Shingle sets of similarity 0.8 have a cosine of 8/9, and
one bit in seven of their fingerprints differs, so no minimum is left at any length of fingerprint. Minima of hashes bring such texts together instead, and their whole sets of shingles
are compared.

A text is the set of its shingles' hashes. Two sets of similarity t agree in a band of ROWS minima with probability t ** ROWS, and in one of BANDS
bands at least with 1 - (1 - t ** ROWS) ** BANDS: 0.99993 at 0.8, and more above. In a first turn, each text of a band's list is compared with the list's hub, the text that shares most places of lists
with others: the original of many copies, which may be alike to it alone. That joins the copies of one text at the cost of about one pair a text, whatever their number. In a second turn, texts of
lists that links haven't joined yet meet by an exact filter: put the shingles of these texts in one order, the rarest first; two sets of similarity t share one of the first n - ceil(t n) + 1 of both.
Of those that do, all pairs that links don't join, and that from the first shared shingle on share enough with any other text at all, are compared. A copy changed in so many places that no other can be similar begins with shingles of its own, and meets none. Equal texts are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FAMILIES, LOWER, U64, bytes_of, cut, drop_scratch, join_by_counts, sift, slices, splitmix, trim, word_hashes, word_spans
from .simhash import components

BANDS, ROWS = 18, 4
#: Texts that one task compares with the same text.
PART = 2000
_ODD = splitmix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's node, a hash of its lower-cased words (0 without any), and its sorted set of shingles' hashes; fewer words than size are one shingle."""
    data, at = bytes_of(column)
    data, at = LOWER[data[at[0] : at[-1]]], at - at[0]
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    node = np.zeros(len(n), dtype=U64)
    node[n > 0] = FAMILIES[0].spans(words, first[:-1][n > 0], first[1:][n > 0])
    each = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    base = np.concatenate([[0], np.cumsum(each)])
    s = np.repeat(first[:-1] - base[:-1], each) + np.arange(base[-1])
    hashes = FAMILIES[1].spans(words, s, np.minimum(s + size, np.repeat(first[1:], each)))
    return node.view(np.int64), [np.unique(hashes[a:b]) for a, b in zip(base[:-1], base[1:])]


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        _, at = bytes_of(batch.column(0))
        for lo, hi in slices(at, 1 << 19):
            part = batch.slice(lo, hi - lo)
            yield part, *shingle_sets(part.column(0), size)
    trim()


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each band's minima, a row a set; no set is empty."""
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.zeros((len(sets), BANDS), dtype=U64)
    for i, odd in enumerate(_ODD):
        keys[:, i // ROWS] = splitmix(keys[:, i // ROWS] + np.minimum.reduceat(every * odd, at) + U64(i))
    return keys


def band_lists(texts: DataFrame, size: int) -> DataFrame:
    """(t, node): each text's bands. Equal texts of a task are listed once."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, node, sets in _parts(batches, size):
            some = [i for i, (x, s) in enumerate(zip(node.tolist(), sets)) if len(s) and x not in done and not done.add(x)]
            if len(done) > 100_000:
                done.clear()
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(band_keys([sets[i] for i in some]).ravel().view(np.int64)), pa.array(np.repeat(node[some], BANDS))], names=["t", "node"])

    return texts.mapInArrow(index, "t long, node long")


def list_sizes(listed: DataFrame) -> DataFrame:
    """(t, n): the lists of several nodes, and their rows. Rows combine before the shuffle, so a list of a third of all texts is a row a task."""
    return listed.groupBy("t").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most").select("t", "n")


def shared_lists(listed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(t, node, n) of the lists of several nodes alone: most lists have one, and their rows are sifted out before the shuffle."""
    return join_by_counts(sift(listed, sizes, "t")[0], sizes, ["t"], "n", by="node").select("t", "node", "n")


def with_hubs(shared: DataFrame) -> DataFrame:
    """(t, node, hub, n): each list's hub is the node whose lists have most rows together, of equal ones the least."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("w"))
    best = F.min(F.struct((-F.col("w")).alias("w"), "node"))
    hubs = shared.join(weight, "node").groupBy("t").agg(best.alias("m"), F.count(F.lit(1)).alias("rows")).select("t", F.col("m.node").alias("hub"), "rows")
    return join_by_counts(shared, cut(hubs, "hubs"), ["t"], "rows", by="node").select("t", "node", "hub", "n")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of a list's hub and another node."""
    return shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def open_nodes(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the nodes of lists that links don't join yet. roots: (node, root) of linked nodes."""
    # lists of two are compared already
    rooted = cut(shared.where("n > 2").join(roots, "node", "left").select("t", "node", F.coalesce("root", "node").alias("root")), "rooted")
    lists = rooted.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("t", "rows")
    return join_by_counts(rooted, cut(lists, "open"), ["t"], "rows", by="node").select("node", "root").distinct()


def prefixes(shingles: DataFrame, similarity: float) -> DataFrame:
    """(t, node, size, used, pos): the shingles by which similar sets meet, with the size of the node's set, how many of it any other set has, and how many of those come before this one. shingles: (node, h), the sets."""
    counts = cut(shingles.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "counts")
    ordered = join_by_counts(shingles, counts, ["h"], "n", by="node").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s"))
    n, shared = F.size("s"), F.filter("s", lambda x: x["n"] > 1)
    # the rarest come first: those of no other set, then the shared ones
    first = (n - F.ceil(n * similarity - 1e-9) + 1).cast("int") - (n - F.size("u"))
    met = ordered.select("node", "s", shared.alias("u")).select("node", n.cast("long").alias("size"), F.size("u").cast("long").alias("used"), F.posexplode(F.slice("u", F.lit(1), F.greatest(first, F.lit(0)))).alias("pos", "x"))
    return met.select(F.col("x.h").alias("t"), "node", "size", "used", F.col("pos").cast("long").alias("pos"))


def unjoined(listed: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different roots in the same list of listed (t, node, size, used) whose sets can be similar enough: from the first shingle that they share they have no more in common than
    either shares with any other from there on. At later ones the same test may fail a pair, but the list of the first has let it through by then. nodes: (node, root)."""
    rooted = cut(listed.join(nodes, "node").select("t", "node", "root", "size", "used"), "rooted")
    lists = rooted.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("t", "rows")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 5
        seen: list[np.ndarray] = []

        def across(t: np.ndarray, root: np.ndarray, node: np.ndarray, size: np.ndarray, used: np.ndarray) -> None:
            # whole lists; a node meets those of later roots in its list
            new = np.flatnonzero(np.diff(t, prepend=t[0] - 1))
            for lo, hi in zip(new, np.append(new[1:], len(t))):
                order = np.lexsort((node[lo:hi], root[lo:hi])) + lo
                r, x, n, u = root[order], node[order], size[order], used[order]
                after = np.searchsorted(r, r, side="right")
                for i in np.flatnonzero(after < len(x)).tolist():
                    able = np.minimum(u[after[i] :], u[i]) * (1 + similarity) >= similarity * (n[after[i] :] + n[i]) - 1e-6
                    other = x[after[i] :][able]
                    seen.append(np.stack([np.minimum(other, x[i]), np.maximum(other, x[i])], axis=1))

        def out() -> pa.RecordBatch:
            # a pair meets in many lists
            x = np.unique(np.concatenate(seen), axis=0)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, batch.column(c).to_numpy()]) for c, h in enumerate(held)]
            whole = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            if whole:
                across(*(c[:whole] for c in cols))
            held = [c[whole:] for c in cols]
            if sum(map(len, seen)) > 200_000:
                yield out()
        if len(held[0]):
            across(*held)
        if seen:
            yield out()

    some = join_by_counts(rooted, cut(lists, "open"), ["t"], "rows", by="node").select("t", "root", "node", "size", "used")
    return some.repartition("t").sortWithinPartitions("t").mapInArrow(pair, "a long, b long").distinct()


def shingles_of(nodes: DataFrame, firsts: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, h): the sets of the given nodes, by one of each node's rows, as in similarities()."""
    some = cut(firsts.join(nodes, "node").select("p", "q"), "open")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, sets in _parts(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, [len(x) for x in sets])), pa.array(np.concatenate([np.zeros(0, dtype=U64), *sets]).view(np.int64))], names=["node", "h"])

    return sift(texts, some, "p")[0].join(some, ["p", "q"]).select("text").mapInArrow(each, "node long, h long").distinct()


def similarities(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs (a, b) with s, their texts' similarity. firsts: (node, p, q), where p and q are 128 bits of hash of one of a node's rows; texts: (text, p, q).

    Each b's set is sent to where its a's is: in one task for up to PART of them, and in as many as it takes for more.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select(F.col("b").alias("node"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    hubs = parts.select(F.col("a").alias("node"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    sent = members.union(hubs).groupBy("node").agg(F.collect_list(F.struct("key", "part", "role")).alias("to"))
    # a written table: its size is known, and decides how texts meet it
    some = cut(firsts.join(sent, "node").select("p", "q", "to"), "compared")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part, node, sets in _parts(batches, size):
            to = part.column(1)
            # repeated rows of one id and text send their set once a task
            keep = np.array([x not in done and not done.add(x) for x in node.tolist()], dtype=bool)
            if len(done) > 100_000:
                done.clear()
            n = np.where(keep, np.diff(to.offsets.to_numpy()), 0)
            each = to.filter(pa.array(keep)).flatten()
            of = np.repeat(np.arange(len(node)), n)
            raw = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([*each.flatten(), pa.array(node[of]), pa.array([raw[i] for i in of.tolist()], pa.binary())], names=["key", "part", "role", "node", "s"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            a, b, s = [], [], []
            for key, part, role, node, x in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                x = np.frombuffer(x.as_buffer(), dtype=U64)
                if role == 0:
                    at, hub = (key, part), x.copy()
                elif (key, part) == at:
                    both = len(np.intersect1d(hub, x, assume_unique=True))
                    a.append(key)
                    b.append(node)
                    s.append(both / (len(hub) + len(x) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "s"])

    met = sift(texts, some, "p")[0].join(some, ["p", "q"]).select("text", "to")
    sets = met.mapInArrow(whole, "key long, part int, role int, node long, s binary")
    out = sets.repartition("key", "part").sortWithinPartitions("key", "part", "role").mapInArrow(measure, "a long, b long, s double")
    out = cut(out.dropDuplicates(["a", "b"]), "similarities")
    drop_scratch(pairs.sparkSession, some)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, a and b (128 bits of hash of id and text) and root, the same for all rows that links of at least this similarity join.

    Texts without a word, null or not, are one group. Texts of any length count whole. Repeated rows come back as often. Other columns are not read. Empty table: empty result.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, node, _ in _parts(batches, 1 << 30):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(node)], names=["doc_id", "a", "b", "node"])

    keyed = docs.select(t.alias("text"), i.cast("long").alias("doc_id"), F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), i, t).alias("b"))
    marked = cut(keyed.mapInArrow(mark, "doc_id long, a long, b long, node long"), "nodes")
    nodes = cut(marked.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b")).alias("first")), "distinct")
    firsts = nodes.select("node", F.col("first.a").alias("p"), F.col("first.b").alias("q"))
    texts = keyed.select("text", F.col("a").alias("p"), F.col("b").alias("q"))
    listed = cut(band_lists(docs.select(t.alias("text")), size), "bands")
    sizes = cut(list_sizes(listed), "sizes")
    shared = cut(shared_lists(listed, sizes), "lists")
    drop_scratch(docs.sparkSession, listed, sizes)
    shared = cut(with_hubs(shared), "lists")
    known = similarities(cut(hub_pairs(shared), "candidates"), firsts, texts, size)
    linked = F.col("s") >= similarity - 1e-9
    roots = components(known.where(linked).select("a", "b"))
    still = cut(open_nodes(shared, roots), "open")
    if not still.isEmpty():
        shingles = cut(shingles_of(still.select("node"), firsts, texts, size), "shingles")
        # of a node's shared shingles, those from the one at hand on
        met = prefixes(shingles, similarity).withColumn("used", F.col("used") - F.col("pos")).drop("pos")
        rest = cut(unjoined(met, still, similarity), "candidates")
        drop_scratch(docs.sparkSession, shingles)
        roots = components(known.union(similarities(rest, firsts, texts, size)).where(linked).select("a", "b"))
    rooted = cut(nodes.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")), "roots")
    drop_scratch(docs.sparkSession, shared, known, still)
    # copies of one text may be a third of all rows: their node is dealt to many tasks
    return join_by_counts(marked, rooted, ["node"], "n", by="a").select("doc_id", "a", "b", "root")
