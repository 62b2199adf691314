"""Packing: every piece once, whole, without gaps or overlaps, in about as few sequences as sequential best fit in order of size needs."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from manifoldry.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def decreasing(sizes, limit):
    """Sequential best fit in order of size."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(limit - s)
    return len(rooms)


def laid_out(rows, limit):
    """Sequences of (offset, length), checked to be gapless and within the limit."""
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def expanded(places):
    return [(q + j // c, o + j % c * s, s) for s, first, n, q, c, o in places for j in range(n)]


def some_lengths(kind, n=600, limit=97):
    rng = random.Random(kind)
    draw = {"small": lambda: rng.randrange(1, 9), "large": lambda: rng.randrange(limit // 2, limit + 1), "any": lambda: rng.randrange(1, limit + 1), "thirds": lambda: rng.choice((32, 33, 33, 34, 1)), "skewed": lambda: min(limit, int(rng.expovariate(1 / 20)) + 1)}[kind]
    return [draw() for _ in range(n)]


@pytest.mark.parametrize("kind", ["small", "large", "any", "thirds", "skewed"])
def test_places_of_all_pieces(spark, kind, monkeypatch):
    lengths, limit = some_lengths(kind), 97

    def here(_, rows, limit):
        return packing.sweep(packing._in_order(rows), 1, limit)

    monkeypatch.setattr(packing, "_round", here)
    places = packing.plan(None, Counter(lengths), limit)
    # each rank of each length once
    assert sorted((s, r) for s, first, n, *_ in places for r in range(first, first + n)) == sorted((s, r) for s, n in Counter(lengths).items() for r in range(n))
    assert laid_out(expanded(places), limit) <= decreasing(lengths, limit) * 1.02 + 1


@pytest.mark.parametrize("span", [30, 8192])
def test_ranges_place_every_piece_once(spark, monkeypatch, span):
    """Spans of 40 lengths and their gaps, in ranges of 30 or in one."""
    monkeypatch.setattr(packing, "RANGE", span)
    lengths = Counter({s: n * 1000 for s, n in Counter(some_lengths("skewed", 400, 40)).items()})
    places = packing.plan(spark, lengths, 40)
    assert sorted((s, first, first + n) for s, first, n, *_ in places)[0][1] == 0
    for s, n in lengths.items():
        at = 0
        for _, first, some, *_ in sorted(p for p in places if p[0] == s):
            assert first == at
            at += some
        assert at == n
    used = laid_out(expanded(places), 40)
    assert used <= -(-sum(s * n for s, n in lengths.items()) // 40) * 1.01


def test_a_million_equal_pieces_are_one_span():
    places = []
    for s, n in ((1, 10**12), (4096, 10**9)):
        left = [(s, packing.ITEM, 0, n)]
        found, rest, taken = packing.sweep([(4096, packing.GAP, 0, 10**9), *left], 1)
        places += found
        assert len(found) == 1 and len(rest) <= 1 and len(taken) <= 2


def test_best_fit_of_a_table(spark):
    lengths = some_lengths("skewed", 700) + [1] * 400
    rows = [(i if i % 7 else None, n, "x") for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "id long, length long, offset_ string").withColumns({"rank": F.lit(1), "n": F.lit("clash"), "size": F.lit("clash")}).repartition(5)
    out = packing.best_fit(df, ["id"], limit=97).collect()
    assert Counter((r.id, r.length) for r in out) == Counter((i, n) for i, n, _ in rows)
    assert {r.n for r in out} == {"clash"}
    used = laid_out([(r.sequence_id, r.offset, r.length) for r in out], 97)
    assert used <= -(-sum(lengths) // 97) + 1
    assert packing.best_fit(df.limit(0), ["id"], limit=97).collect() == []
    with pytest.raises(ValueError):
        packing.best_fit(df, ["id"], limit=5)


def test_pieces_are_those_of_the_library(spark, tmp_path):
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma's", "délta", "(eps)", "\n", "日本", "42"]
    long = " ".join(rng.choices(words, k=9000))
    texts = [None, "", " \n", "one", long, "x" * 30_000, *(" ".join(rng.choices(words, k=rng.randrange(1, 900))) for _ in range(120)), *["same text"] * 60]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "one"), (3, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("clash"), "length": F.lit("clash"), "ids": F.lit("clash")}).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            some = np.array(ids[at : at + 4096], dtype="<u4").tobytes()
            want[(i, at // 4096, at, len(some) // 4, zlib.crc32(some))] += 1
    out = queries.op12_best_fit_packing(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    used = laid_out([(r.sequence_id, r.offset, r.length) for r in out], 4096)
    lengths = [k[3] for k, n in want.items() for _ in range(n)]
    assert used <= decreasing(lengths, 4096)
    # the sequences themselves
    with open(PATH, encoding="utf-8") as f:
        pieces = packing.token_pieces(df, f.read())
    held = packing.packed_sequences(packing.best_fit(pieces, ["doc_id", "piece", "ids"])).collect()
    assert len(held) == used and all(len(r.ids) == 4 * r.n_tokens and sum(r.lengths) == r.n_tokens <= 4096 for r in held)
    assert Counter((d, zlib.crc32(bytes(r.ids)[4 * a : 4 * (a + n)])) for r in held for d, n, a in zip(r.doc_ids, r.lengths, np.cumsum([0, *r.lengths]).tolist())) == Counter({k: v for k, v in Counter((i, c) for (i, _, _, _, c), n in want.items() for _ in range(n)).items()})
