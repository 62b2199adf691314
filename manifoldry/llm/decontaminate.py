"""Benchmark decontamination by latent semantic retrieval.

TF-IDF counts A = C D of all passages of the corpus, over hashed words, go through a randomised SVD. In one pass every task counts in how many passages each
feature stands and adds up its share of the power product C' C S, where S has DRAWN columns of random signs, some more than are kept. All of this is whole numbers, so the sums are exact
and don't depend on how rows fall into partitions. With D, the features' weights, known after the pass, D C' C S = A' A O for O = S / D, and from this one product the
driver solves the small problem that gives the leading right singular vectors (Nystroem's form; Tropp and others, 2017). Passages at several
lengths and the benchmark's items are projected and whitened; pairs of high cosine are candidates, and so is every passage, whatever its cosine,
that has as many of an item's rarest words as a hit can't do without. A candidate is a hit if the longest common subsequence of words holds enough
of the item, and enough of its answer, the item's last words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FAMILIES, U64, append_columns, bytes_of, slices, trim, word_hashes, word_spans

#: Hashed words, and singular vectors kept and drawn.
FEATURES = 1 << 15
RANK, DRAWN = 48, 64
#: A feature with more words than this in a slice of the corpus is frequent there.
FEW = 64
#: Words of a passage in the statistics, and of the blocks that searched passages are made of.
PASSAGE, BLOCK = 32, 8
COSINE = 0.4
#: Shares of an item's words, and of its answer's words, that must appear in order.
SHARE, ANSWER_SHARE, ANSWER = 0.8, 0.6, 5
#: Below this many words, an item must appear whole and in one piece.
SHORT = 8
#: Items of a benchmark, and bytes of their texts, that are searched for at once; a longer benchmark is searched in turns.
ITEMS, ITEM_BYTES = 4096, 16 << 20
#: Features in at most this share of passages are rare.
RARE = 0.02
#: An item with too few rare words to ask for so many of them in a hit has its next rarest words counted too.
ASKED = 3

#: Bytes that part words here: ASCII other than letters and digits.
_PUNCTUATION = np.array([not (chr(i).isalnum()) and i < 128 for i in range(256)])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and each row's first word."""
    data, at = bytes_of(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    data = np.where(_PUNCTUATION[data], np.uint8(32), data)
    starts, ends, first = word_spans(data, at)
    return word_hashes(data, starts, ends), first


def _feature(words: np.ndarray) -> np.ndarray:
    return (words & U64(FEATURES - 1)).astype(np.int64)


def _runs(feature: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words in runs of `size`: a matrix of features with FEATURES where a row's last run is short, and each word's run."""
    n = np.diff(first)
    base = np.concatenate([[0], np.cumsum(-(-n // size))])
    place = np.arange(len(feature)) - np.repeat(first[:-1] - first[0], n)
    run = np.repeat(base[:-1], n) + place // size
    out = np.full((int(base[-1]), size), FEATURES)
    out[run, place % size] = feature
    return out, run


def _sums(runs: np.ndarray, of_feature: np.ndarray) -> np.ndarray:
    """Each run's sum of rows of of_feature, whose last row, for no word, is 0."""
    out = of_feature[runs[:, 0]]
    for j in range(1, runs.shape[1]):
        out += of_feature[runs[:, j]]
    return out


def _closed(of_feature: np.ndarray) -> np.ndarray:
    return np.concatenate([of_feature, np.zeros((1, of_feature.shape[1]), dtype=of_feature.dtype)])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for batch in batches:
        _, at = bytes_of(batch.column(0))
        for lo, hi in slices(at, 1 << 19):
            yield batch.column(0).slice(lo, hi - lo)
    trim()


#: Pieces that the tasks' sums are cut into, and tasks whose sums are added at a time.
PIECES, WIDTH = 32, 256
SUMS = "piece int, task int, part binary"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, in half the space if they are small, and compressed: those of one task mostly are small or 0."""
    small = np.abs(x).max(initial=0) < 1 << 31
    raw = x.astype(np.int32 if small else np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + bytes([4 if small else 8]) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    whole = pa.decompress(raw[9:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(whole, dtype=np.int32 if raw[8] == 4 else np.int64).astype(np.int64)


def _total(texts: DataFrame, task_sums) -> np.ndarray | None:
    """The sum over all tasks of task_sums(parts of texts), a matrix of whole numbers with a row a feature; None without a task. Two levels of adding, so no task reads a row of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sums = task_sums(_parts(batches))
        part = [_packed(x.ravel()) for x in np.split(sums, PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([task] * PIECES, pa.int32()), pa.array(part, pa.binary())], names=["piece", "task", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("part"):
            x = _unpacked(x.as_py())
            total = x if total is None else total + x
        return pa.table({"piece": table.column("piece")[:1], "task": table.column("task")[:1], "part": pa.array([_packed(total)], pa.binary())})

    rows = texts.mapInArrow(run, SUMS)
    once = rows.groupBy("piece", F.floor(F.col("task") / WIDTH).alias("some")).applyInArrow(lambda table: add(table), SUMS)
    # the driver gets PIECES rows of one size, whatever the corpus
    got = {r.piece: _unpacked(r.part) for r in once.groupBy("piece").applyInArrow(lambda table: add(table), SUMS).collect()}
    return np.concatenate([got[i] for i in range(PIECES)]).reshape(FEATURES, -1) if got else None


def _signs(seed: int) -> np.ndarray:
    """FEATURES rows of DRAWN random signs, and a row of 0 for no word."""
    return _closed((np.random.default_rng(seed).integers(0, 2, (FEATURES, DRAWN)) * 2 - 1).astype(np.int8))


def _scatter(out: np.ndarray, feature: np.ndarray, run: np.ndarray, of_run: np.ndarray) -> None:
    """out[feature] += of_run[run] for all words. of_run: whole numbers of at most PASSAGE in size."""
    # rank of each word among those of its feature
    order = np.argsort(feature.astype(np.uint16), kind="stable")
    times = np.bincount(feature, minlength=FEATURES)
    many = times > FEW
    heads = np.cumsum(times) - times
    # frequent features, as a matrix of their counts in runs
    column = np.cumsum(many) - 1
    of = many[feature]
    if of.any():
        width = int(many.sum())
        counts = np.bincount(run[of] * width + column[feature[of]], minlength=len(of_run) * width).reshape(-1, width)
        out[many] += (counts.astype(np.float32).T @ of_run.astype(np.float32)).astype(np.int64)
    # the others: all first words of a feature, all second words, and so on
    some = np.flatnonzero((times > 0) & ~many)
    some = some[np.argsort(-times[some], kind="stable")]
    left, wide = np.searchsorted(-times[some], -np.arange(1, FEW + 1), side="right"), of_run.astype(np.int16)
    sums = np.zeros((len(some), of_run.shape[1]), dtype=np.int16)
    for j in range(FEW):
        if not left[j]:
            break
        sums[: left[j]] += wide[run[order[heads[some[: left[j]]] + j]]]
    out[some] += sums


def latent_basis(texts: DataFrame, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES x RANK: takes counts of features to whitened latent coordinates; and the share of passages that have each feature. All passages of texts (one column) take part."""

    def power(parts: Iterator[pa.Array]) -> np.ndarray:
        signs = _signs(seed)
        # the product, the number of passages that have each feature, and in the first row the number of all
        out = np.zeros((FEATURES, DRAWN + 2), dtype=np.int64)
        for part in parts:
            words, first = _words(part)
            feature = _feature(words)
            runs, run = _runs(feature, first, PASSAGE)
            if not len(runs):
                continue
            # a sum of at most PASSAGE signs
            _scatter(out[:, :DRAWN], feature, run, _sums(runs, signs))
            key = np.sort(run * FEATURES + feature)
            out[:, DRAWN] += np.bincount(key[np.diff(key, prepend=-1) > 0] % FEATURES, minlength=FEATURES)
            out[0, DRAWN + 1] += len(runs)
        return out

    sums = _total(texts, power)
    n = 0 if sums is None else int(sums[0, DRAWN + 1])
    if not n:
        return np.zeros((FEATURES, RANK), dtype=np.float32), np.zeros(FEATURES)
    df = sums[:, DRAWN]
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0)
    inverse = np.where(df > 0, 1 / np.maximum(idf, 1e-30), 0)
    # an orthonormal O, and the product with it
    drawn, r = np.linalg.qr(inverse[:, None] * _signs(seed)[:-1])
    y = np.linalg.lstsq(r.T, (idf[:, None] * sums[:, :DRAWN]).T, rcond=1e-10)[0].T
    shift = 1e-9 * np.linalg.norm(y)
    y += shift * drawn
    core = drawn.T @ y
    # eigenvalues of the core, rather than a factor that rounding can spoil
    w, v = np.linalg.eigh((core + core.T) / 2)
    u, s, _ = np.linalg.svd(y @ (v / np.sqrt(np.maximum(w, 1e-12 * max(w[-1], 1e-30)))), full_matrices=False)
    s = np.sqrt(np.maximum(s * s - shift, 0))
    u = u * np.where(u[np.abs(u).argmax(axis=0), range(u.shape[1])] < 0, -1, 1)
    scale = np.where(s > 1e-4 * max(s[0], 1e-30), 1 / np.maximum(s, 1e-30), 0)[:RANK]
    basis = (idf[:, None] * u[:, :RANK] * scale * s[0]).astype(np.float32)
    trim()
    return basis, df / n


def lcs(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the pattern."""
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v = full
    for w in text:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


class Items:
    """Benchmark items: their words, and their latent coordinates by passage length."""

    def __init__(self, ids: list, texts: list[str], basis: np.ndarray, common: np.ndarray):
        words, first = _words(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(first[:-1], first[1:])]
        self.lists = [x.tolist() for x in self.words]
        self.counts = []
        for x in self.words:
            u, n = np.unique(x, return_counts=True)
            self.counts.append((u, n))
        # a hit has all but a fifth of the item's words, each at its own place, so so many of its rare words at least are in the region
        miss = [len(x) - int(np.ceil(SHARE * len(x))) if len(x) >= SHORT else 0 for x in self.words]
        of_rare = []
        for x, (u, n), lost in zip(self.words, self.counts, miss):
            share = common[_feature(u)]
            order = np.argsort(share, kind="stable")
            take = max(int((share <= RARE).sum()), int(np.searchsorted(np.cumsum(n[order]), ASKED + lost)) + 1)
            of_rare.append(np.isin(x, u[order[:take]]))
        pair = np.unique(np.array([(w, i) for i, (x, r) in enumerate(zip(self.words, of_rare)) for w in x[r].tolist()], dtype=U64).reshape(-1, 2), axis=0)
        self.rare, self.rare_at = np.unique(pair[:, 0], return_index=True)
        self.rare_at = np.append(self.rare_at, len(pair))
        self.rare_item = pair[:, 1].astype(np.int64)
        self.need = np.array([int(r.sum()) - lost for r, lost in zip(of_rare, miss)], dtype=np.int64)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, x in enumerate(self.words):
            if len(x):
                by.setdefault(max(2 * BLOCK, 1 << int(np.ceil(np.log2(len(x) + BLOCK)))), []).append(i)
        for length, members in by.items():
            z = np.stack([basis[_feature(self.words[i])].sum(axis=0) for i in members])
            norm = np.linalg.norm(z, axis=1, keepdims=True)
            self.classes[length] = (np.array(members), (z / np.where(norm > 0, norm, 1)).astype(np.float32))

    def rare_places(self, words: np.ndarray) -> np.ndarray:
        """item * (len(words) + 1) + position of every rare word of an item among words, sorted."""
        if not len(self.rare):
            return np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.rare, words)
        at[at == len(self.rare)] = 0
        position = np.flatnonzero(self.rare[at] == words)
        lo, hi = self.rare_at[at[position]], self.rare_at[at[position] + 1]
        n = hi - lo
        item = self.rare_item[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return np.sort(item * (len(words) + 1) + np.repeat(position, n))

    def dense(self, rare: np.ndarray, n_words: int, members: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (region, item of members) with as many of the item's rare words as it needs. Regions run from a to b, both ascending; rare: from rare_places."""
        lo, hi = np.searchsorted(rare, members * (n_words + 1)), np.searchsorted(rare, (members + 1) * (n_words + 1))
        starts = np.maximum(hi - lo - self.need[members] + 1, 0)
        item = np.repeat(members, starts)
        x = np.repeat(lo - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
        p, q = rare[x] - item * (n_words + 1), rare[x + self.need[item] - 1] - item * (n_words + 1)
        near = q - p < int((b - a).max(initial=0))
        p, q, item = p[near], q[near], item[near]
        # the regions that hold both ends of a run of words
        lo, hi = np.searchsorted(b, q, side="right"), np.searchsorted(a, p, side="right")
        n = np.maximum(hi - lo, 0)
        region = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found = np.unique(region * len(self.ids) + np.repeat(item, n))
        return found // len(self.ids), found % len(self.ids)

    def matches(self, i: int, region: np.ndarray) -> float:
        """The share of item i's words found in order in the region, or 0 if that isn't a hit."""
        item = self.lists[i]
        n = len(item)
        if n < SHORT:
            inside = region.tolist()
            return float(any(inside[s : s + n] == item for s in range(len(inside) - n + 1)))
        need = int(np.ceil(SHARE * n))
        u, times = self.counts[i]
        at = np.searchsorted(u, region)
        at[at == len(u)] = 0
        there = np.bincount(at[u[at] == region], minlength=len(u))
        if np.minimum(there, times).sum() < need:
            return 0.0
        inside = region.tolist()
        found = lcs(item, inside)
        answer = item[-ANSWER:]
        return found / n if found >= need and lcs(answer, inside) >= ANSWER_SHARE * len(answer) else 0.0


def _search(words: np.ndarray, first: np.ndarray, basis: np.ndarray, items: Items, cosine: float) -> list[dict[int, float]]:
    """For each row, the items it holds, with the largest share of words found in any of its regions. basis: closed by a row of 0."""
    hits: list[dict[int, float]] = [{} for _ in range(len(first) - 1)]
    seen: set[tuple[int, int, int]] = set()

    def hold(row: int, i: int, a: int, b: int) -> None:
        if (i, a, b) in seen or hits[row].get(i, 0.0) >= 1.0:
            return
        seen.add((i, a, b))
        if (share := items.matches(i, words[a:b])) > hits[row].get(i, 0.0):
            hits[row][i] = share

    n = np.diff(first)
    per_row = -(-n // BLOCK)
    base = np.concatenate([[0], np.cumsum(per_row)])
    if not base[-1]:
        return hits
    row_of = np.repeat(np.arange(len(n)), per_row)
    number = np.arange(base[-1]) - base[row_of]
    heads = first[row_of] + number * BLOCK
    sums = _sums(_runs(_feature(words), first, BLOCK)[0], basis)
    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
    rare = items.rare_places(words)
    for length, (members, z) in items.classes.items():
        step, span = max(1, length // 4 // BLOCK), length // BLOCK
        start = np.flatnonzero((number % step == 0) & ((number == 0) | (number + span - step < per_row[row_of])))
        end = np.minimum(start + span, base[row_of[start] + 1])
        p = (total[end] - total[start]).astype(np.float32)
        norm = np.linalg.norm(p, axis=1)
        for lo in range(0, len(start), 1 << 14):
            q = p[lo : lo + (1 << 14)] @ z.T
            near, which = np.nonzero(q >= cosine * norm[lo : lo + (1 << 14), None])
            s, i = start[lo + near], members[which]
            a = np.maximum(first[row_of[s]], heads[s] - length // 4)
            b = np.minimum(first[row_of[s] + 1], heads[s] + length + length // 4)
            able = np.searchsorted(rare, i * (len(words) + 1) + b) - np.searchsorted(rare, i * (len(words) + 1) + a) >= items.need[i]
            for row, i, a, b in zip(row_of[s[able]].tolist(), i[able].tolist(), a[able].tolist(), b[able].tolist()):
                hold(row, i, a, b)
        # what the cosine has left out
        a = np.maximum(first[row_of[start]], heads[start] - length // 4)
        b = np.minimum(first[row_of[start] + 1], heads[start] + length + length // 4)
        region, item = items.dense(rare, len(words), members, a, b)
        for row, i, a, b in zip(row_of[start[region]].tolist(), item.tolist(), a[region].tolist(), b[region].tolist()):
            hold(row, i, a, b)
    return hits


HITS = "benchmark_hits array<struct<item_id: bigint, share: double>>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE, turn_items: int = ITEMS) -> DataFrame:
    """docs with a column benchmark_hits: the items that each row's text holds, by smallest item_id, with the share of the item's words found in order.

    Words are lower-cased runs without ASCII punctuation or white space. Items of under SHORT words must appear whole, in one piece; items without a word
    match nothing. Null or empty texts have no hits, as have items of null text; long texts are searched whole. Repeated rows are judged alike. Repeated items: each is listed. Items of null id are listed with a null id.
    Other columns are kept (or those in keep); one named benchmark_hits is replaced. An empty table or benchmark: no hits.
    """
    spark = docs.sparkSession
    basis, common = latent_basis(docs.select(F.col(f"`{text_col}`").alias("text")))
    shared = spark.sparkContext.broadcast((_closed(basis), common))
    asked = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    # the benchmark is a stated list; it is taken in turns of about turn_items items and ITEM_BYTES, in no need of more memory when it is longer
    n, size = asked.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    turns = max(1, -(-n // turn_items), -(-(size or 0) // ITEM_BYTES))
    out, names = docs, []
    for turn in range(turns):
        rows = asked.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(turns)) == turn).collect()
        lists = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        made: dict[str, Items] = {}

        def run(column: pa.Array, lists=lists, made=made) -> list[pa.Array]:
            basis, common = shared.value
            if "it" not in made:
                made["it"] = Items(*lists.value, basis, common)
            items, found = made["it"], []
            _, at = bytes_of(column)
            for lo, hi in slices(at, 1 << 19):
                words, first = _words(column.slice(lo, hi - lo))
                found += _search(words, first, basis, items, cosine)
            order = lambda h: sorted(({"item_id": items.ids[i], "share": s} for i, s in h.items()), key=lambda x: (x["item_id"] is None, x["item_id"] or 0))
            return [pa.array([order(h) for h in found], pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())])))]

        name = "benchmark_hits" if turns == 1 else f"__hits_{turn}"
        out = append_columns(out, text_col, HITS.replace("benchmark_hits", name), run, keep=None if turns > 1 else keep)
        names.append(name)
    if turns > 1:
        both = F.array_sort(F.concat(*names))
        out = out.withColumn("benchmark_hits", both).drop(*names)
        out = out if keep is None else out.select(*keep, "benchmark_hits")
    return out
