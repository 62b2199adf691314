"""Line dedup over windows of three consecutive lines, in DataFrame functions only.

Every window of three lines of a text gets a 128-bit hash. A window found again keeps its first occurrence; of every later one, the lines it covers go. Covered
positions are merged to runs, and a text is put together again from the slices between its runs. Only texts that lose lines, and the few that a filter takes for
such, meet their positions in a shuffle; all others stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_counts, sift

LINES = 3


def _key(id_col: str, text_col: str) -> list[Column]:
    """What a row is known by: whether its id is null, its id, and a hash of its text; none of these is null."""
    i = F.col(f"`{id_col}`").cast("long")
    return [i.isNull().alias("__null"), F.coalesce(i, F.lit(0)).alias("__id"), F.xxhash64(F.col(f"`{text_col}`")).alias("__k")]


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, h1, h2) of every window; place orders them by null, id, text hash and position, which counts from 0."""
    lines = F.split(F.col(f"`{text_col}`"), "\n", -1)
    some = docs.select(*_key(id_col, text_col), lines.alias("lines")).where(F.size("lines") >= LINES)
    window = lambda i: [F.get("lines", i + j) for j in range(LINES)]
    hashes = F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), lambda i: F.struct(F.xxhash64(*window(i)).alias("h1"), F.xxhash64(F.lit(1), *window(i)).alias("h2")))
    each = some.select("__null", "__id", "__k", F.posexplode(hashes).alias("pos", "h"))
    return each.select(F.struct("__null", "__id", "__k", "pos").alias("place"), "h.h1", "h.h2")


def later_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__null, __id, __k, __covered): the sorted starts of each text's windows whose lines stand, in the same order, in an earlier window anywhere."""
    windows = line_windows(docs, id_col, text_col)
    # copies combine before the shuffle, so a window that a third of all texts share is a row a task; in the join it is dealt to many tasks
    first = cut(windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "windows")
    later = join_by_counts(windows, first, ["h1", "h2"], "n", by="place").where("first <> place").select("place.*")
    return later.groupBy("__null", "__id", "__k").agg(F.sort_array(F.collect_set("pos")).alias("__covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated three-line windows taken out of the text column, and new columns n_lines and n_removed (long).

    The first occurrence, by smallest id, then text hash, then position, stays; null ids come last. Lines are parted by a newline and compared as they are.
    Null text: stays null, n_lines 0. Empty text: one empty line. Texts under three lines: unchanged; long ones count whole. Repeated rows of one id and text count as one text and
    come out alike. Windows may overlap within a text. Other columns are kept; ones named n_lines or n_removed are replaced. Empty table: empty result.
    """
    gone = cut(later_windows(docs, id_col, text_col), "gone")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # names of this function's own meanwhile, so that none of docs' can clash with one in use here
    safe = {c: f"__c{i}" for i, c in enumerate(names)}
    keyed = docs.select(*(F.col(f"`{c}`").alias(s) for c, s in safe.items()), *_key(id_col, text_col))
    may, rest = sift(keyed, gone, "__k")
    both = may.join(gone, ["__null", "__id", "__k"], "left").unionByName(rest.withColumn("__covered", F.lit(None).cast("array<int>")))
    text = F.col(safe[text_col])
    lines = F.split(text, "\n", -1)
    p = F.col("__covered")
    # a run begins at a start that none of the starts just before reaches, and ends likewise
    begins = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - LINES))
    ends = F.transform(F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + LINES)), lambda x: x + LINES)
    with_runs = both.withColumn("__b", begins).withColumn("__e", ends).withColumn("__lines", lines)
    b, e, n = F.col("__b"), F.col("__e"), F.size("__lines")
    lo = lambda i: F.when(i == 0, 0).otherwise(F.get(e, i - 1))
    hi = lambda i: F.when(i == F.size(b), n).otherwise(F.get(b, i))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: F.slice("__lines", lo(i) + 1, hi(i) - lo(i))))
    removed = F.aggregate(F.arrays_zip(b.alias("b"), e.alias("e")), F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["b"])
    out = F.when(p.isNull(), text).otherwise(F.array_join(kept, "\n"))
    return with_runs.select(*((out if c == text_col else F.col(s)).alias(c) for c, s in safe.items()), F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))
