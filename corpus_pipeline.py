"""From raw documents to token ids, in five stages. Each stage's rows are written as Parquet in the shared folder and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifoldry.llm import queries
from manifoldry.llm.common import cut, join_by_counts, sift, small_batches
from manifoldry.llm.copies import near_copies
from manifoldry.llm.decontaminate import benchmark_hits
from manifoldry.llm.language import UNKNOWN, identify
from manifoldry.llm.lines import dedup_lines
from manifoldry.llm.pieces import decode_pieces, encode_pieces
from manifoldry.llm.simhash import components, simhash_near_dups

#: A document stays if the mean probability of its language is at least this.
SURE = 0.5
#: Words of a shingle, and the share of all shingles of two documents that near copies have in common.
SHINGLE, SIMILAR = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language is uncertain. Learns from the documents themselves, outside the held-out fold.

    Without any labelled document there is nothing to learn from and all would be unknown: all stay. Null texts go, as they have no letter. Repeated rows go or stay alike.
    """
    field = queries.language_field(docs)
    if not field.languages:
        return docs
    labelled = identify(docs, field)
    return labelled.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated three-line windows out of the texts; n_chars follows the text. No document goes. Null texts stay null, long ones are taken whole; repeated rows of one id and text come out alike."""
    out = dedup_lines(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def joined_groups(given: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, a, b and root of groups that links of either kind join: those of op5's operator, by its index of bytes, and those of near_copies, for similarities that no index of bytes reaches."""
    alike = cut(simhash_near_dups(given, with_keys=True).select("doc_id", "a", "b", "root"), "alike")
    close = near_copies(given, size=shingle, similarity=similarity).select("a", "b", F.col("root").alias("close")).distinct()
    both = cut(alike.select("a", "b", "root").distinct().join(close, ["a", "b"]).select("root", "close").distinct(), "both")
    # groups that are one and the same by both need no joining
    several = [both.groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}")) for c in ("root", "close")]
    edges = both.join(several[0], "root").join(several[1], "close").where("n_root > 1 or n_close > 1")
    node = lambda c: F.xxhash64(F.lit(c), c)
    found = components(edges.select(node("root").alias("a"), node("close").alias("b")))
    # a group of both kinds is named by the component's root, which is of neither
    named = alike.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("node", node("root")).join(found.withColumnRenamed("root", "of"), "node", "left").select("root", "n", F.coalesce("of", "node").alias("of"))
    return join_by_counts(alike, cut(named, "named"), ["root"], "n", by="a").select("doc_id", "a", "b", F.col("of").alias("root"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, shingle: int | None = None, similarity: float | None = None) -> DataFrame:
    """Keep one document of each group of near copies: the one of smallest doc_id, null ids last; of repeated rows of one id and text, one.

    Near copies have fingerprints of op5's contract within two bits or, if both are given, at least this Jaccard similarity of shingles of so many words. Null and empty
    texts are copies of each other; long texts count whole. Only rows that may be in a group of several are shuffled.
    """
    keys = [F.xxhash64("doc_id", "text").alias("__a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("__b")]
    given = docs.select("doc_id", "text")
    with small_batches(spark):
        found = simhash_near_dups(given, with_keys=True) if shingle is None or similarity is None else joined_groups(given, shingle, similarity)
        marked = cut(found.select("doc_id", "a", "b", "root"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "a", "b")
    groups = cut(marked.groupBy("root").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "n", F.col("m.a").alias("first_a"), F.col("m.b").alias("first_b")), "several")
    several = join_by_counts(marked, groups, ["root"], "n", by="a")
    several = cut(several.select(F.col("a").alias("__a"), F.col("b").alias("__b"), (F.struct("a", "b") != F.struct("first_a", "first_b")).alias("__goes")).distinct(), "several")
    # columns go by place meanwhile, so that none can clash with a name in use here
    safe = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    back = [F.col(s).alias(c) for c, s in safe.items()]
    may, rest = sift(docs.select(*(F.col(f"`{c}`").alias(s) for c, s in safe.items()), *keys), several, "__a")
    stay = may.join(several.where("__goes"), ["__a", "__b"], "left_anti").dropDuplicates(["__a", "__b"])
    return stay.select(*back).union(rest.select(*back))


def similar_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """near_dedup by op5's fingerprints, and by five-word shingles and a similarity of 0.8."""
    return near_dedup(spark, docs, sf_dir, SHINGLE, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark. Null and empty texts hold none and stay, long ones are searched whole; repeated rows go or stay alike.

    128 bits of hash stand for the texts that go, so that no other column passes through the workers, and none work while the rest is written.
    """
    hashes = [F.xxhash64("text").alias("__a"), F.xxhash64(F.lit(1), "text").alias("__b")]
    with small_batches(spark):
        marked = benchmark_hits(docs.select("text", *hashes), queries.table(spark, sf_dir, "benchmark"), keep=["__a", "__b"])
        found = cut(marked.where(F.size("benchmark_hits") > 0).select("__a", "__b").distinct(), "hits")
    safe = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    back = [F.col(s).alias(c) for c, s in safe.items()]
    may, rest = sift(docs.select(*(F.col(f"`{c}`").alias(s) for c, s in safe.items()), *hashes), found, "__a")
    return may.join(found, ["__a", "__b"], "left_anti").select(*back).union(rest.select(*back))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces, and whether decoding the ids gives the text back; spaces written as U+2581 come back as spaces. Null texts are encoded as empty ones, long ones whole; repeated rows give repeated rows, an empty table none."""
    model = queries.piece_model()
    given = docs.select("doc_id", F.coalesce(F.regexp_replace("text", "▁", " "), F.lit("")).alias("__given"))
    # 128 bits of hash stand for the text, so that no text goes through the workers or is written for the sake of the comparison
    hashes = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(1), c))
    marked = given.select("doc_id", "__given", *(h.alias(n) for h, n in zip(hashes("__given"), ("__g", "__h"))))
    # written in between, so that the workers that encode and those that decode don't stand side by side in memory
    encoded = cut(encode_pieces(marked, model, text_col="__given", keep=["doc_id", "__g", "__h"]), "pieces")
    g, h = hashes("decoded")
    back = decode_pieces(encoded, model)
    return back.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), ((g == F.col("__g")) & (h == F.col("__h"))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", similar_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages of language ID and decontamination can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
