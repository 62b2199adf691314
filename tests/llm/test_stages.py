"""Stages of the pipeline."""

from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_decontamination_sends_texts_alone(spark, monkeypatch):
    """Before: all columns went to the workers and back, in batches of up to 64 MB."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("__a", F.lit(5))
    size, hits, asked = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), P.benchmark_hits, []

    def spy(given, *more, **how):
        asked.append((given.columns, how["keep"], spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return hits(given, *more, **how)

    monkeypatch.setattr(P, "benchmark_hits", spy)
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    null = docs.limit(1).withColumn("text", F.lit(None).cast("string"))
    planted = docs.limit(1).withColumn("text", F.lit(item)).withColumn("doc_id", F.lit(-7).cast(docs.schema["doc_id"].dataType))
    given = docs.union(null).union(planted).union(planted)
    kept = P.decontamination(spark, given, DIR)
    direct = hits(given, spark.read.parquet(f"{DIR}/benchmark.parquet")).where(F.size("benchmark_hits") == 0).select(*given.columns)
    assert kept.columns == given.columns and sorted(map(str, kept.collect())) == sorted(map(str, direct.collect()))
    assert kept.where("doc_id = -7").count() == 0 and kept.where("text is null").count() >= 1
    assert asked == [(["text", "__a", "__b"], ["__a", "__b"], "4m")] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == size


def test_near_dedup_joins_groups_of_both_kinds(spark):
    """Before: the pipeline's stage left out op5's operator, and kept both of two documents of one fingerprint whose shingles differ."""
    import corpus_pipeline as P
    from manifoldry.llm.copies import near_copies
    from manifoldry.llm.simhash import simhash_near_dups

    phrase = "one two three four five six seven "
    tail = lambda name: " ".join(f"{name}{i}" for i in range(14))
    far = " ".join(f"x{i}" for i in range(200))
    texts = [phrase * 60 + tail("p"), phrase * 60 + tail("q"), far, far + " more", tail("r"), None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots = lambda df: len({r.root for r in df.collect()})
    assert roots(near_copies(docs)) == 5 and len({r.root for r in simhash_near_dups(docs).where("doc_id < 2").collect()}) == 1
    assert sorted(r.doc_id for r in P.similar_dedup(spark, docs, DIR).collect()) == [0, 2, 4, 5]


def test_near_dedup_chains_links_of_both_kinds(spark):
    """0 and 1 have one fingerprint, 1 and 2 similar shingles; one of the three stays."""
    import corpus_pipeline as P

    phrase = "one two three four five six seven "
    tail = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = spark.createDataFrame([(0, phrase * 60 + tail("p", 40)), (1, phrase * 60 + tail("q", 40)), (2, phrase + tail("q", 40))], "doc_id long, text string")
    assert [r.doc_id for r in P.similar_dedup(spark, docs, DIR).collect()] == [0]
