"""Periodic runs against every start and every period tried by hand, and the query against the words of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from manifoldry.llm import queries, runs


def plain(words, least=6, times=4):
    """All runs, period by period from the smallest: stretches whose words q apart are equal, less those that have a smaller period."""
    out, whole = [], set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if j > i and end - start >= max(least, times * q) and (start, end) not in whole:
                whole.add((start, end))
                out.append((start, end - start, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(rng, n, alphabet):
    words = [rng.choice(alphabet) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        q, at = rng.randrange(1, max(2, n // 5)), rng.randrange(n)
        for i in range(at + q, min(n, at + int(q * rng.uniform(2, 7)))):
            words[i] = words[i - q]
    return words


def found_in(lists, **how):
    numbers = {w: i for i, w in enumerate(sorted({w for d in lists for w in d}))}
    flat = np.array([numbers[w] for d in lists for w in d], dtype=np.int64)
    got = runs.find_runs(flat, np.concatenate([[0], np.cumsum([len(d) for d in lists])]), **how)
    return [got.get(i, []) for i in range(len(lists))]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_documents(seed):
    rng = random.Random(seed)
    lists = [planted(rng, rng.randrange(0, 90), "abcdefgh"[: rng.randrange(1, 8)]) for _ in range(400)]
    assert found_in(lists) == [plain(d) for d in lists]
    assert found_in(lists[:100], least=9, times=3) == [plain(d, 9, 3) for d in lists[:100]]


def test_runs_of_long_documents(monkeypatch):
    rng = random.Random(9)
    many = [f"w{i}" for i in range(3000)]
    lists = [planted(rng, n, many) for n in (400, 1500, 3000)] + [["a"] * 3000, ["a", "b"] * 900 + ["c"] + ["a", "b"] * 900, (["a"] * 30 + ["b"]) * 40, []]
    want = [plain(d) for d in lists]
    assert found_in(lists) == want
    # automata over a few blocks at a time
    monkeypatch.setattr(runs, "SEARCHED", 8)
    assert found_in(lists) == want
    assert any(q > 100 for d in want for _, _, q in d)


def test_stretches_of_two_documents_that_touch():
    assert found_in([["a"] * 5, ["a"] * 5, ["a"] * 6]) == [[], [], [(0, 6, 1)]]


def test_equal_words_in_large_numbers():
    assert found_in([["same"] * 200_000]) == [[(0, 200_000, 1)]]
    assert found_in([["x", "y", "x"] * 50_000]) == [[(0, 150_000, 3)]]


def turned(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_the_query_on_awkward_documents(spark, tmp_path):
    rng = random.Random(2)
    draw = lambda n: rng.choice((" ", "\n", "\t\x0b ")).join(planted(rng, n, ["a", "b", "ç", "日", "E", "f g"]))
    rows = [(i, draw(rng.randrange(1, 200))) for i in range(150)] + [(None, draw(50)), (200, None), (201, ""), (202, " \n"), (203, "go " * 5000), (203, "go " * 5000), (210, " ".join(f"w{i}" for i in range(4000)))]
    rows += [(i, None) for i in range(300, 320)] + [(i, "lonely") for i in range(320, 340)] + [(i, " ".join(f"v{i}" for i in range(900))) for i in range(340, 380)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "n_words", "collapsed", "g", "w", "a", "p", "n")}).repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, text in rows:
        words = turned(re.findall(r"[^\x20\x09-\x0D]+", text or ""), i)
        found = plain(words)
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((i, len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(words, found))))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = runs.periodic_runs(df).collect()
    assert {r.g for r in kept} == {"clash"} and len(kept) == len(rows)
    assert runs.periodic_runs(df.limit(0)).collect() == []
