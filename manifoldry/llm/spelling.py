"""Spelling variants: words within one edit of each other, found by an even-partition pigeonhole join, and the most frequent form of each.

A word of L code points is cut into two segments, the first of L // 2. One edit touches one of them, so the other stands unchanged in any word one edit away: in a word of equal length at
the same place, in a word one shorter either at the same place or moved by one. Words are indexed by each segment, with the length, and every word probes the segments of words of
its own length and of one more. A segment that very many words share (a common beginning or end) is refined by the same argument: the part around the edit is cut evenly again, until few words
share all the rest or a single place is left open, which at most as many words share as there are letters. So no bucket's pairs grow with its square, and none is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_scratch, join_by_counts

LETTERS = r"A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that share a key before it is refined: each is compared with no more than these.
BUCKET = 64


def letter_runs(docs: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters of at least so many code points, A-Z lower-cased and nothing else. Null and empty texts have none; long texts are taken whole."""
    # a shorter run holds no match, and in a longer one the first match is all of it
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    runs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(found).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    return runs.select("doc_id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())).alias("run"))


def count_words(words: DataFrame, least: int = 6, occurrences: int = 5) -> DataFrame:
    """(word, n): the distinct words of at least so many code points and occurrences. Tasks send one row for each word that they met."""
    long_enough = words.where(F.char_length("word") >= least)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def _key(of: str, length: Column, lo: Column, hi: Column, moved: Column) -> Column:
    """A hash of what stands outside the open part [lo, hi) of a word of the given length; moved: 1 where the word is one shorter and what follows the open part stands one place earlier."""
    w = F.col(of)
    return F.xxhash64(length, lo, hi, w.substr(F.lit(1), lo), w.substr(hi - moved + 1, length))


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b, n_a, n_b): every two distinct words of (word, n) that exactly one inserted, deleted or replaced code point tells apart, once. Words of any length; an empty table gives none."""
    size = F.char_length("word")
    # as indexed words, which stand for those of equal length as well, and as probes for words one longer
    indexed = words.select("word", "n", size.alias("len"), F.lit(0).alias("moved"))
    probes = words.select("word", "n", (size + 1).alias("len"), F.lit(1).alias("moved"))
    half = F.floor(F.col("len") / 2).cast("int")
    segments = F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("len").alias("hi"))))
    rows = indexed.union(probes).select("*", segments.alias("part")).select("word", "n", "len", "moved", "part.lo", "part.hi").where("hi > lo")
    pairs = None
    while True:
        rows = cut(rows.select("*", _key("word", F.col("len"), F.col("lo"), F.col("hi"), F.col("moved")).alias("key")), "segments")
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("moved").alias("__probe"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        # a key of one word, or of probes alone, brings no two together
        counts = cut(counts.where("members > 1 AND __probe = 0").select("key", "members", ((F.col("members") > bucket) & (F.col("open") > 1)).alias("refine")), "keys")
        held = join_by_counts(rows, counts, ["key"], "members", by="word")
        # at most `bucket` members, or as many as there are letters for the one open place
        few = held.where("NOT refine").groupBy("key").agg(F.collect_list(F.struct("word", "n", "moved")).alias("members"))
        paired = few.select(F.explode(F.filter("members", lambda m: m["moved"] == 0)).alias("a"), "members").select("a", F.explode("members").alias("b"))
        found = paired.where("b.moved = 1 OR a.word < b.word").select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
        pairs = found if pairs is None else pairs.union(found)
        if not counts.where("refine").limit(1).count():
            break
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi")))
        rows = held.where("refine").select("word", "n", "len", "moved", halves.alias("part")).select("word", "n", "len", "moved", "part.lo", "part.hi").where("hi > lo")
    # two segments may bring the same words together, and a key's hash others that differ by more
    return pairs.distinct().where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that forms lead to. Each round doubles the steps taken. Forms must not go round in a circle."""
    known = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(known.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not further.where("moved").isEmpty()
        drop_scratch(known.sparkSession, known)
        known = further.select("word", "root")
        if not moved:
            return known


def spelling_groups(words: DataFrame, times: int = 5, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), one row a word.

    n_near: how many words are one edit away. form: the most frequent of them, ties to the smallest in code-point order, if it has at least `times` the word's occurrences. root: where following
    forms ends. Null words and repeated rows must have been grouped away, as count_words does. Empty table: no rows.
    """
    words = cut(words.select("word", "n"), "words")
    pairs = cut(near_words(words, bucket), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    told = cut(told, "forms")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
