"""Spelling variants against all pairs of words, and the query against a plain version, on awkward rows."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from manifoldry.llm import queries
from manifoldry.llm.spelling import count_words, letter_runs, near_words, spelling_groups


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=5):
    by = {w: sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: (v[0] if v and counts[v[0]] >= times * counts[w] else None) for w, v in by.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), counts[w], len(by[w]), counts.get(form[w])) for w in counts}


def some_words(alphabet="abé", n=400, seed=0):
    rng = random.Random(seed)
    words = {"".join(rng.choices(alphabet, k=rng.randrange(6, 10))) for _ in range(n)}
    words |= {"x" * 500, "x" * 501, "x" * 200 + "y" + "x" * 299, "aaaaaa", "aaaaaaa", "baaaaa"}
    return {w: rng.choice((5, 5, 6, 30, 200, 5000)) for w in sorted(words)}


@pytest.mark.parametrize("bucket", [4, 64])
def test_near_words_are_those_of_all_pairs(spark, bucket):
    counts = some_words()
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = [(r.a, r.b) for r in near_words(df, bucket).collect()]
    assert {frozenset(p) for p in found} == {frozenset(p) for p in combinations(counts, 2) if near(*p)}
    assert len(found) == len({frozenset(p) for p in found})


def test_a_beginning_that_all_words_share(spark):
    """20,000 words alike but for their last letters: the pairs compared stay near the pairs found, not all 200 million."""
    rng = random.Random(1)
    words = {"prefix" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20_000)}
    some = sorted(words)[:300]
    words |= {w[:-1] + ("q" if w[-1] != "q" else "r") for w in some}
    df = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    found = {frozenset((r.a, r.b)) for r in near_words(df).collect()}
    # every word less one letter, by hand
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    assert found == {frozenset(p) for v in by.values() for p in combinations(v, 2)}


def test_groups_forms_and_roots(spark):
    counts = some_words(seed=3) | {"kettle": 20_000, "ketle": 9, "kettles": 3000, "kettels": 5, "kettlfs": 500, "ketttlfs": 90, "ketttlfss": 10}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling_groups(df).collect()} == plain(counts)
    tied = spark.createDataFrame([("abcdef", 1), ("abcdeg", 9), ("abcdeé", 9), ("bbcdef", 9)], "word string, n long")
    assert {r.word: r.form for r in spelling_groups(tied).collect()}["abcdef"] == "abcdeg"


def test_no_words(spark):
    assert spelling_groups(spark.createDataFrame([], "word string, n long")).collect() == []
    assert spelling_groups(spark.createDataFrame([("single", 5)], "word string, n long")).collect()[0][:3] == ("single", None, "single")


def test_the_query_on_awkward_documents(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["wonderful", "Wonderful", "ÉÉcole", "garçons", "garçonÿ", "tiny", "many×ways", "letters÷"] + ["".join(rng.choices("abcd", k=7)) for _ in range(30)]
    rows = [(i, rng.choice((" ", "-", "1")).join(rng.choices(vocabulary, k=60))) for i in range(400)]
    rows += [(None, "wonderful " * 50), (7, None), (8, ""), (9, "wonderful " * 3000), (9, "wonderful"), (10, "ŴÀlong" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("run", F.lit("clash")).withColumn("key", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, str(tmp_path)).collect()} == plain(counts)


def test_counting(spark):
    df = spark.createDataFrame([(1, "Aa aA, À àŸ"), (2, None)], "doc_id long, text string")
    assert sorted(r.run for r in letter_runs(df).collect()) == ["aa", "aa", "À", "à"]
    words = spark.createDataFrame([("abcdef",)] * 5 + [("abcdeg",)] * 4 + [("abc",)] * 9 + [(None,)] * 9, "word string")
    assert [tuple(r) for r in count_words(words).collect()] == [("abcdef", 5)]
