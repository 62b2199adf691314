"""Columns that are named like the ones operators use inside keep their values."""

import random
from collections import Counter

from pyspark.sql import functions as F

from manifoldry.llm.decontaminate import benchmark_hits
from manifoldry.llm.lines import dedup_lines
from manifoldry.llm.runs import periodic_runs

NAMES = ["__k", "__id", "__null", "__covered", "__word", "__may", "__bits", "__a", "__b", "__e", "__lines", "__goes", "__text", "__c0", "__c1", "__salt", "__hot"]


def docs(spark):
    rng = random.Random(0)
    line = "\n".join(" ".join(rng.choices(["ab", "cd", "ef", "gh"], k=6)) for _ in range(3))
    rows = [(i, f"{line}\nown line {i}" if i % 3 else f"other {i}") for i in range(40)] + [(3, "other 3"), (3, "other 3"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES})
    return rows, df


def kept(out, rows):
    want = Counter(tuple(f"{c}{'-' if i is None else i}" for c in NAMES) for i, _ in rows)
    return Counter(tuple(r[c] for c in NAMES) for r in out.collect()) == want


def test_line_dedup(spark):
    rows, df = docs(spark)
    out = dedup_lines(df)
    assert kept(out, rows) and out.columns == [*df.columns, "n_lines", "n_removed"]
    plain = Counter(tuple(r) for r in dedup_lines(df.select("doc_id", "text")).collect())
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()) == plain and any(k[3] for k in plain)


def test_others(spark):
    rows, df = docs(spark)
    assert kept(periodic_runs(df), rows)
    bench = spark.createDataFrame([(1, "nothing like it at all in here today or tomorrow")], "item_id long, text string")
    assert kept(benchmark_hits(df, bench), rows)


def test_near_dedup_of_the_pipeline(spark):
    import corpus_pipeline

    rows, df = docs(spark)
    out = corpus_pipeline.near_dedup(spark, df, "", 3, 0.8)
    plain = corpus_pipeline.near_dedup(spark, df.select("doc_id", "text"), "", 3, 0.8)
    got = out.collect()
    assert out.columns == df.columns and Counter((r.doc_id, r.text) for r in got) == Counter(map(tuple, plain.collect())) and 0 < len(got) < len(rows)
    assert all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for r in got for c in NAMES)
