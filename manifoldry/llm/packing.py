"""Best-fit packing by bulk-synchronous sweeps.

Pieces of equal length are interchangeable, and so are sequences with equal room, so both are sorted and matched as spans: a length with a run of ranks of its pieces, a room with a run of
sequence numbers. There are no more item spans than `limit`, and each of them parts no more than two gap spans when it runs out, so what a round carries depends on `limit` alone, whatever the number of documents.

A round takes the largest open pieces, as many as there are gaps that could hold one, sorts them and all gaps by size and cuts them into ranges, which are swept side by side, from large to small: a gap is laid
on a stack, a piece takes the gap on top, which is its successor, the smallest that holds it; pieces of one length that meet in one gap take as much of it as they fill, by rank, and go on with the
next. A gap that has taken something comes back at its new place in the range, if it has one there. What the ranges leave, pieces that found no gap and gaps that no piece took, is swept once more across the ranges. Gaps that
have fallen below their range come back in the next round. The first gaps are those beside the largest pieces, one for each sequence that the pieces need at least; when no open piece fits anywhere, more
sequences are opened.

In the end every piece looks up its place by length and rank. Ranks are counted by part of the table, so a length that a third of all pieces have isn't counted or placed in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, slices, trim
from .token_files import PART, WordEncoder

LIMIT = 4096
#: The pieces that take part in a round, as a share of the gaps that could hold one: the less, the closer to best fit in order of size, and the more rounds.
ADMITTED = 1.0
#: Spans of a range.
RANGE = 512

ITEM, GAP = 1, 0


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str) -> WordEncoder:
    return WordEncoder(tokenizer_json)


def token_pieces(docs: DataFrame, tokenizer_json: str, end_id: int = 1, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's ids and end_id, cut into pieces of `limit`, the last of what is left. ids: binary, little-endian unsigned 32-bit integers.

    Null and empty texts are one end_id; texts of any length are encoded whole; other columns are not read; rows of equal ids stay documents of their own.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            for lo, hi in slices(at, PART):
                ids, first = _encoder(tokenizer.value).encode(data, at[lo : hi + 1])
                size = np.diff(first) + 1
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                number = -(-size // limit)
                doc = np.repeat(np.arange(hi - lo), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * limit
                length = np.minimum(limit, size[doc] - start)
                bounds = np.concatenate([[0], np.cumsum(length)]) * 4
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), raw], names=["doc_id", "piece", "start", "length", "ids"])
        trim()

    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def sweep(rows: list[tuple[int, int, int, int]], floor: int, limit: int = LIMIT) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """One sweep over (size, kind, first, n), from large to small, gaps before pieces of equal size: (places, rows left, gaps that have taken something and have less room than floor).

    A place (length, rank, n, sequence, copies, offset): n pieces from that rank go to sequences from that number, so many to each, side by side from that offset.
    """
    stack: list[list[int]] = []
    again: list[tuple[int, int, int]] = []
    places, left, below = [], [], []

    def back(size: int) -> None:
        """Lay gaps that have taken something on the stack once nothing larger is to come."""
        while again and -again[0][0] >= size:
            room, sequence, many = heapq.heappop(again)
            stack.append([-room, sequence, many])

    def used(room: int, sequence: int, many: int) -> None:
        if room >= floor:
            heapq.heappush(again, (-room, sequence, many))
        elif room:
            below.append((room, GAP, sequence, many))

    for size, kind, first, n in rows:
        back(size)
        if kind == GAP:
            stack.append([size, first, n])
            continue
        while n and stack:
            room, sequence, many = stack[-1]
            copies = room // size
            placed = min(n, many * copies)
            full, rest = divmod(placed, copies)
            places.append((size, first, placed, sequence, copies, limit - room))
            first, n = first + placed, n - placed
            if full + (rest > 0) == many:
                stack.pop()
            else:
                stack[-1][1:] = [sequence + full + (rest > 0), many - full - (rest > 0)]
            if full:
                used(room - copies * size, sequence, full)
            if rest:
                used(room - rest * size, sequence + full, 1)
            back(size)
        if n:
            left.append((size, ITEM, first, n))
    return places, left + [(size, GAP, first, n) for size, first, n in stack] + [(-room, GAP, first, n) for room, first, n in again], below


def _in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (-r[0], r[1], r[2]))


_SPAN = (("range", pa.int32()), ("size", pa.int32()), ("kind", pa.int32()), ("first", pa.int64()), ("n", pa.int64()))
_SWEPT = (("what", pa.int32()), *_SPAN[1:], ("sequence", pa.int64()), ("copies", pa.int32()), ("at", pa.int32()))


def _table(rows: list[tuple], fields: tuple) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[name for name, _ in fields])


def _round(spark, rows: list[tuple], limit: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """sweep() of spans in any order: range by range in the cluster, then of what the ranges leave."""
    rows = _in_order(rows)
    number = -(-len(rows) // RANGE)
    spans = spark.createDataFrame(_table([(i * number // len(rows), *r) for i, r in enumerate(rows)], _SPAN))

    def run(table: pa.Table) -> pa.Table:
        mine = _in_order([tuple(r.values())[1:] for r in table.to_pylist()])
        places, left, below = sweep(mine, mine[-1][0], limit)
        return _table([(0, s, ITEM, f, n, q, c, o) for s, f, n, q, c, o in places] + [(w, *r, 0, 0, 0) for w, part in ((1, left), (2, below)) for r in part], _SWEPT)

    places, left, below = [], [], []
    # spans again, whose number doesn't depend on that of the documents
    for r in spans.groupBy("range").applyInArrow(run, ", ".join(f"{name} {'long' if t == pa.int64() else 'int'}" for name, t in _SWEPT)).collect():
        if r.what == 0:
            places.append((r.size, r.first, r.n, r.sequence, r.copies, r.at))
        else:
            (left if r.what == 1 else below).append((r.size, r.kind, r.first, r.n))
    if number > 1:
        more, left, _ = sweep(_in_order(left), 1, limit)
        places += more
    return places, left, below


def plan(spark, counts: dict[int, int], limit: int = LIMIT, admitted: float = ADMITTED) -> list[tuple]:
    """Places, as sweep() gives them, for so many pieces of each length; sequences are numbered from 0."""
    if any(not 1 <= s <= limit for s in counts):
        raise ValueError(f"lengths must be from 1 to {limit}")
    items = [(s, ITEM, 0, n) for s, n in sorted(counts.items(), reverse=True)]
    gaps: list[tuple] = []
    places: list[tuple] = []
    opened = 0

    def start(number: int, rows: list[tuple]) -> list[tuple]:
        """Open so many sequences, each with one of the largest pieces; the rows without those pieces."""
        nonlocal opened
        out = []
        for size, _, first, n in _in_order(rows):
            some = min(number, n)
            if some:
                places.append((size, first, some, opened, 1, 0))
                gaps.append((limit - size, GAP, opened, some))
                opened, number = opened + some, number - some
            if n > some:
                out.append((size, ITEM, first + some, n - some))
        return out

    total = lambda rows: sum(r[0] * r[3] for r in rows)
    large = sum(n for s, _, _, n in items if 2 * s > limit)
    items = start(max(large, -(-total(items) // limit)), items)
    while items:
        least = min(r[0] for r in items)
        # no piece will ever fit these: they are as full as they get
        gaps = [g for g in gaps if g[0] >= least]
        number = max(1, int(admitted * sum(g[3] for g in gaps)))
        now, later = [], []
        for size, _, first, n in _in_order(items):
            some = min(number, n)
            number -= some
            now += [(size, ITEM, first, some)] if some else []
            later += [(size, ITEM, first + some, n - some)] if n > some else []
        found, left, below = _round(spark, now + gaps, limit) if gaps else ([], now, [])
        places += found
        gaps = [r for r in left if r[1] == GAP] + below
        items = [r for r in left if r[1] == ITEM]
        if not found:
            items = start(-(-total(items) // limit), items)
        items = _joined(items + later)
    return places


def _joined(items: list[tuple]) -> list[tuple]:
    """Runs of one length that follow each other as one."""
    out: list[tuple] = []
    for r in sorted(items, key=lambda r: (r[0], r[2])):
        if out and out[-1][0] == r[0] and out[-1][2] + out[-1][3] == r[2]:
            before = out.pop()
            r = (r[0], ITEM, before[2], before[3] + r[3])
        out.append(r)
    return out


def best_fit(items: DataFrame, order: list[str], limit: int = LIMIT, length: str = "length", admitted: float = ADMITTED) -> DataFrame:
    """items with sequence_id and offset: rows of lengths 1 to limit in as few sequences as best fit needs, each sequence filled without gaps from offset 0, in no more than limit.

    order: columns that tell equally long rows apart; rows that they don't tell apart are repeated rows, whose places may be exchanged. Columns may be null, the length not. Empty table: no rows.
    """
    spark = items.sparkSession
    # written once, so that parts and what is in them stay what they are
    written = cut(items.withColumn("__part", F.spark_partition_id()), "pieces")
    size = F.col(f"`{length}`")
    counts = cut(written.groupBy(size.alias("__length"), "__part").agg(F.count(F.lit(1)).alias("__n")), "counts")
    # at most `limit` rows
    totals = {r[0]: r[1] for r in counts.groupBy("__length").agg(F.sum("__n")).collect()}
    if not totals:
        return written.drop("__part").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    before = Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select("__length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")), "bases")
    rows = plan(spark, {int(s): int(n) for s, n in totals.items()}, limit, admitted)
    names = ("__length", "__first", "__some", "__sequence", "__copies", "__at")
    # spans again; written, so that their size decides how they are joined
    places = cut(spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=list(names))), "places")
    nth = F.row_number().over(Window.partitionBy("__length", "__part").orderBy(*order)) - 1
    ranked = written.withColumn("__length", size.cast("long")).withColumn("__nth", nth)
    # merged: the table of bases has a row for each part and length, and grows with the parts; ranked rows lie as the window has left them
    ranked = ranked.join(bases.withColumn("__length", F.col("__length").cast("long")).hint("merge"), ["__length", "__part"]).withColumn("__rank", F.col("__base") + F.col("__nth"))
    found = ranked.join(places, (ranked["__length"] == places["__length"]) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__some")))
    j = F.col("__rank") - F.col("__first")
    return found.select(*(written[c] for c in items.columns), (F.col("__sequence") + F.floor(j / F.col("__copies"))).cast("long").alias("sequence_id"), (F.col("__at") + j % F.col("__copies") * places["__length"]).cast("long").alias("offset"))


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids, lengths): what best_fit has placed of token_pieces, a row a sequence; ids as in the pieces, one piece behind the other in order of offset."""
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    parts = placed.groupBy("sequence_id").agg(held.alias("held"))
    whole = F.aggregate("held", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", F.aggregate("held", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"), whole.alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.length").alias("lengths"))

