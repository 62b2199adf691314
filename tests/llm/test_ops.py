"""Each operator against a plain version of what it says, on awkward rows: nulls, empty, very long and repeated texts, ties, clashing columns, empty tables."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use themselves.
CLASH = ["fp", "score", "n_words", "piece_ids", "benchmark_hits", "block", "k", "h1", "n_lines", "covered", "lines", "b", "row"]


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts():
    rng = random.Random(0)
    base = words(rng, 120)
    near = base.copy()
    near[60] = "other"
    shared = words(rng, 50)
    line = ["\n".join(" ".join(words(rng, 6)) for _ in range(3)) for _ in range(3)]
    out = [None, "", " \n\t ", "one", "two words", "...!!! 123", "é日本 ß", "a▁b  c", " ".join(base), " ".join(base), " ".join(near)]
    out += [" ".join(words(rng, 20) + shared + words(rng, 30)), " ".join(words(rng, 5) + shared[:34] + words(rng, 9)), " ".join(shared[:35]), " ".join(words(rng, 40) + shared[10:] + words(rng, 7))]
    out += [line[0], f"x y\n{line[0]}\nz", f"{line[1]}\n{line[1]}", f"{line[0]}\n{line[2]}\n{line[0]}", "\n\n\n\n\n", "tail\n", f"{line[2]}\n{line[1]}\n"]
    out += [" ".join(words(rng, 30_000)), "x" * 200_000, "ab " * 500, " ".join(["same"] * 80), "Released under the MIT License.", " ".join(words(rng, 90) + ["Licensed", "under", "the", "Apache", "License,", "Version", "2.0."])]
    return out


def rows():
    texts = odd_texts()
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(None, texts[8], None, None, None), (None, None, "fr", None, 0), out[11], out[11], (8, "one more text of id eight", "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(items):
    return Counter(items)


def test_substring_dedup(docs, empty):
    from manifoldry.llm.substring import COVER, PERIOD, substring_dedup

    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    w = [(r[0], (r[1] or "").encode().split()) for r in rows()]
    seen = Counter(tuple(x[s : s + 35]) for _, x in w for s in range(len(x) - 34))
    expected = []
    for i, x in w:
        gone = [False] * len(x)
        for s in range(len(x) - 34):
            if seen[tuple(x[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        expected.append((i, len(x), sum(gone), b" ".join(a for a, g in zip(x, gone) if not g).decode()))
    got = substring_dedup(docs).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == bag(expected)
    for r in got:
        assert sum(b - a for a, b in zip(r.removed_from, r.removed_to)) == r.n_removed
    assert substring_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(docs, window=20)
    small = substring_dedup(docs, window=8, period=7, cover=(0, 1, 3))
    assert small.agg(F.sum("n_removed")).first()[0] > sum(r.n_removed for r in got)
    assert not [t.name for t in docs.sparkSession.catalog.listTables() if t.name.startswith("blocks")]


def test_substring_dedup_in_many_blocks_and_buckets(spark, monkeypatch):
    from manifoldry.llm import substring

    rng = random.Random(21)
    shared = [words(rng, 60) for _ in range(5)]
    data = []
    for i in range(200):
        w = words(rng, 30, 100_000) + (rng.choice(shared) if i % 3 == 0 else []) + words(rng, 30, 100_000)
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    usual = bag(map(tuple, substring.substring_dedup(df).select("doc_id", "n_removed", "text").collect()))
    assert sum(r[1] for r in usual) == 60 * len(range(0, 200, 3))
    monkeypatch.setattr(substring, "BUCKET_KEYS", 30_000)
    assert bag(map(tuple, substring.substring_dedup(df).select("doc_id", "n_removed", "text").collect())) == usual


def test_scratch_is_cleared(spark):
    from manifoldry.llm.common import clear_scratch, cut

    df = cut(spark.range(5), "some")
    folder = df.inputFiles()[0].removeprefix("file://").split("/some/")[0]
    assert df.count() == 5 and clear_scratch(spark) > 0
    import os

    assert not os.path.exists(folder) and clear_scratch(spark) == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_of_components(items, linked):
    parent = list(range(len(items)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(items)), 2):
        if linked(items[a], items[b]):
            parent[top(a)] = top(b)
    return [top(i) for i in range(len(items))]


def test_simhash(docs, empty):
    from manifoldry.llm.simhash import simhash_near_dups

    fps = [plain_fingerprint(r[1]) for r in rows()]
    tops = least_of_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {t: min((r[0] for r, u in zip(rows(), tops) if u == t and r[0] is not None), default=None) for t in tops}
    got = simhash_near_dups(docs).collect()
    assert bag((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == bag((r[0], f, least[t]) for r, f, t in zip(rows(), fps, tops))
    assert simhash_near_dups(empty).count() == 0


def test_simhash_links_and_components(spark):
    from manifoldry.llm.simhash import components, links

    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    for r in edges.collect():
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 2
    tops = least_of_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    root = {r.node: r.root for r in components(edges).collect()}
    for i, j in combinations(range(len(fps)), 2):
        assert (tops[i] == tops[j]) == (root.get(signed[i], signed[i]) == root.get(signed[j], signed[j]))


def test_nearest(spark):
    from manifoldry.llm.nearest import Block, Heaps, nearest

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[10] = x[20] = x[30]
    data = [(i, r.tolist()) for i, r in enumerate(x)]
    bad = [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [float("inf")] * 16), (504, [None] * 16), (505, []), (None, [1.0] * 16), (550, [1.0, 2.0])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).withColumn("b", F.lit(1))
    got = nearest(df, df.where("vec_id % 50 = 0"), 5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = []
    for q in range(0, 300, 50):
        s = sorted((-round(float(unit[q] @ unit[j]), 12), j) for j in range(300) if j != q)[:5]
        expected += [(q, i + 1, j) for i, (_, j) in enumerate(s)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == expected
    assert all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12 for r in got)
    few = nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert nearest(df.where("vec_id < 0"), df.where("vec_id < 0"), 5).count() == 0
    heaps = Heaps(Block.of(np.arange(2), x[:2]), 7)
    for lo in (0, 150):
        heaps.meet(Block.of(np.arange(lo, lo + 150), x[lo : lo + 150]))
    assert heaps.rows().num_rows == 14


def test_nearest_ranks_repeated_rows(spark):
    from manifoldry.llm.nearest import nearest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[7] = x[0] + 0.01
    data = [(i, r.tolist()) for i, r in enumerate(x)] + [(7, x[7].tolist())] * 2 + [(7, (2 * x[7]).tolist())] + [(50, x[50].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in data]
    for k in (3, 6):
        expected = []
        for q in (0, 50):
            s = sorted((-round(float(u @ v), 12), j) for i, u in unit if i == q for j, v in unit if j != q)[:k]
            expected += [(q, i + 1, j) for i, (_, j) in enumerate(s)]
        for parts in (1, 5):
            got = nearest(df.repartition(parts), df.where("vec_id % 50 = 0"), k).collect()
            assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == expected


def test_nearest_in_many_blocks_with_a_hot_vector(spark):
    from manifoldry.llm.nearest import nearest

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:600] = x[0]
    x[600:700] = x[1] + 3e-3 * rng.normal(size=(100, 8))
    ids = [7 if 400 <= i < 500 else i for i in range(900)]
    data = [(i, r.tolist()) for i, r in zip(ids, x)] + [(2000 + i, rng.normal(size=4).tolist()) for i in range(9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    asked = df.where("vec_id % 25 = 0 or vec_id = 7")
    u = np.array([r / np.linalg.norm(r) for r in x.astype(np.float64)])
    score = np.round(u @ u.T, 12)
    expected = []
    for q in sorted({i for i in ids if i % 25 == 0 or i == 7}):
        mine = [i for i, v in enumerate(ids) if v == q]
        expected += [(q, r + 1, v) for r, (_, v) in enumerate(sorted((-score[i, j], ids[j]) for i in mine for j in range(900) if ids[j] != q)[:5])]
    got = nearest(df, asked, 5, block=64).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got if r.query_id < 2000) == expected
    wide = [(2000, a[0]) for a in data if 2000 < a[0] < 2009]
    assert {r.vec_id for r in got if r.query_id == 2000} <= {v for _, v in wide} and sum(r.query_id == 2000 for r in got) == 5


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    from manifoldry.llm.pieces import Encoder, Pieces, decode_ids, decode_pieces, encode_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = decode_pieces(encode_pieces(docs, model, keep=["doc_id", "text"]), model).collect()
    assert bag((r.doc_id, tuple(r.piece_ids)) for r in got) == bag((r[0], tuple(library.encode(r[1] or ""))) for r in rows())
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in got)
    assert set(encode_pieces(docs, model).columns) == set(docs.columns)
    assert encode_pieces(empty, model).count() == 0
    raw = open(model, "rb").read()
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "th", "e", " ", "  ", "\n", "é", "日", "😀", "\x00", ".", "1", "▁", "ing"]) for _ in range(rng.randrange(60))) for _ in range(800)]
    enc = Encoder(Pieces(raw))
    from manifoldry.llm.common import bytes_of

    ids, first = enc.encode(*bytes_of(pa.array(texts)))
    token = Pieces.tokens(raw)
    for i, t in enumerate(texts):
        mine = ids[first[i] : first[i + 1]].tolist()
        assert mine == library.encode(t)
        assert decode_ids(*token, mine) == library.decode(mine)


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    from manifoldry.llm.token_files import read_documents, sequences, write_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    text = open(path, encoding="utf-8").read()
    special = spark.createDataFrame([(100, "It's <|endoftext|> THE <|ENDOFTEXT|> we'll", None, None, 0)], SCHEMA)
    given = docs.select("doc_id", "text").union(special.select("doc_id", "text"))
    folder = f"file://{tmp_path}/out"
    files = write_tokens(given, folder, text, length=64)
    got = read_documents(spark, files, folder).orderBy("start").collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    all_rows = [*((r[0], r[1]) for r in rows()), (100, special.first().text)]
    assert bag((r.doc_id, tuple(np.frombuffer(r.ids, dtype="<u4"))) for r in got) == bag((i, tuple(ids(t))) for i, t in all_rows)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    part = files.orderBy("part").first()
    x, mask = sequences(folder, part.part, 0)
    first = np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in got if part.start <= r.start < part.start + part.n_tokens])[:64]
    assert x.shape == (1, 64) and x[0][mask.to_numpy(zero_copy_only=False)].tolist() == first.tolist() and not x.flags.owndata and len(mask) == 64
    assert not list(tmp_path.glob("out/*.tmp"))
    assert read_documents(spark, write_tokens(empty, f"file://{tmp_path}/none", text), f"file://{tmp_path}/none").count() == 0


def test_word_encoder_equals_the_library_on_random_texts(monkeypatch):
    from tokenizers import Tokenizer

    from manifoldry.llm import token_files
    from manifoldry.llm.common import bytes_of

    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(text)
    rng = random.Random(22)
    bits = ["a", "B", "the", "It's", "'ll", "'", "\"", " ", "  ", "\t", "\n", "\r\n", "\x00", "\x1f", "\u00a0", "\u3000", "é", "É", "ß", "İ", "日本", "😀", "\u0301", "\ufffd", "1", "23", ".", ",", "!?", "$%", "<|endoftext|>", "<|", "|>", "_", "-", "x2y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    monkeypatch.setattr(token_files, "SMALL", 1000)
    wide = token_files.WordEncoder(text)
    monkeypatch.undo()
    narrow = token_files.WordEncoder(text)
    assert narrow.dtype == np.uint16 and wide.dtype == np.uint32
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for encoder in (narrow, wide):
        ids, first = encoder.encode(*bytes_of(pa.array(texts)))
        assert ids.dtype == encoder.dtype and [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == expected
    # slice by slice, with a memory that is too small for the words
    monkeypatch.setattr(token_files, "REMEMBERED", 60)
    for lo in range(0, 3000, 50):
        ids, first = narrow.encode(*bytes_of(pa.array(texts[lo : lo + 50])))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == expected[lo : lo + 50] and len(narrow.keys) <= 60


def test_language_field():
    from manifoldry.llm.language import posteriors

    rng = np.random.default_rng(0)
    n, k = [5, 0, 1, 150, 64, 65], 3
    first = np.concatenate([[0], np.cumsum(n)])
    s, a, start = rng.normal(size=(first[-1], k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k)
    got = posteriors(s, first, a, start)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi == lo:
            continue
        f, b = [start + s[lo]], [np.zeros(k)]
        for t in range(lo + 1, hi):
            f.append(np.logaddexp.reduce(f[-1][:, None] + a, axis=0) + s[t])
        for t in range(hi - 1, lo, -1):
            b.append(np.logaddexp.reduce(a + (s[t] + b[-1])[None], axis=1))
        z = np.array(f) + np.array(b[::-1])
        p = np.exp(z - np.logaddexp.reduce(z, axis=1)[:, None])
        assert np.abs(p - got[lo:hi]).max() < 1e-9


def test_language_posteriors_of_many_languages():
    from manifoldry.llm import language

    rng = np.random.default_rng(2)
    n, k = [70, 3, 0, 130], 5
    first = np.concatenate([[0], np.cumsum(n)])
    given = rng.normal(size=(first[-1], k)), first, rng.normal(size=(k, k)), rng.normal(size=k)
    blocks, pairs = language.posteriors(*given, pairs=True)
    few, language.FEW = language.FEW, 2
    try:
        whole, pairs_whole = language.posteriors(*given, pairs=True)
    finally:
        language.FEW = few
    assert np.abs(blocks - whole).max() < 1e-12 and np.abs(pairs - pairs_whole).max() < 1e-9
    assert abs(pairs.sum() - sum(max(x - 1, 0) for x in n)) < 1e-9


def test_language_gradient():
    from manifoldry.llm.language import BLOCK, Field

    rng = np.random.default_rng(4)
    n, k = [6, 1, BLOCK + 5, 3], 3
    heads = np.concatenate([[0], np.cumsum(n)])
    scores, truth = rng.normal(size=(heads[-1], k)), rng.integers(0, k, heads[-1])
    field = Field(list("abc"))
    field.transition, field.start = rng.normal(size=(k, k)), rng.normal(size=k)

    def likelihood(s, a, b):
        out = 0.0
        for lo, hi in zip(heads[:-1], heads[1:]):
            z = b + s[lo]
            out += (b + s[lo])[truth[lo]]
            for t in range(lo + 1, hi):
                z = np.logaddexp.reduce(z[:, None] + a, axis=0) + s[t]
                out += a[truth[t - 1], truth[t]] + s[t, truth[t]]
            out -= np.logaddexp.reduce(z)
        return out

    g, g_t, g_s = field.gradient(scores, heads, truth)
    given, h = [scores, field.transition, field.start], 1e-5
    for which, mine in enumerate((g, g_t, g_s)):
        for at in list(np.ndindex(mine.shape))[:40]:
            up, down = [x.copy() for x in given], [x.copy() for x in given]
            up[which][at] += h
            down[which][at] -= h
            assert abs((likelihood(*up) - likelihood(*down)) / (2 * h) - mine[at]) < 1e-6


def test_language_sample_keeps_every_language(spark):
    from manifoldry.llm.language import identify, train_field, training_texts

    rng = random.Random(9)
    make = lambda s, n: " ".join("".join(rng.choices(s, k=2)) for _ in range(n))
    some = [make(["eau", "oi", "que"], 40) for _ in range(20)]
    data = [(make(["ka", "lo", "mi"], 40), "aa") for _ in range(1500)] + [(t, "cc") for t in some] * 100 + [(make(["sch", "ung", "ein"], 40), "bb")]
    df = spark.createDataFrame(data, "text string, lang string").repartition(5).cache()
    found = training_texts(df, docs=50)
    assert Counter(lang for lang, _ in found) == {"aa": 50, "bb": 1, "cc": 20} and {t for lang, t in found if lang == "cc"} == set(some)
    assert Counter(lang for lang, _ in training_texts(df, docs=50, total=2)) == {"aa": 1, "bb": 1, "cc": 1}
    long = make(["ka", "lo", "mi"], 100_000)
    assert (("aa", long)) in training_texts(spark.createDataFrame([(long, "aa")], "text string, lang string"))
    got = identify(df, train_field(df, docs=50))
    assert got.where("lang = lang_pred").count() == len(data)


def test_language_id(spark, docs, empty):
    from manifoldry.llm import queries
    from manifoldry.llm.language import Field, identify, train_field

    rng = random.Random(0)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oi", "que"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(n))
    data = [(make(x, rng.randint(5, 60)), x) for x in syllables for _ in range(60)]
    field = train_field(spark.createDataFrame([*data, (None, "aa"), ("text", None)], "text string, lang string"))
    assert field.languages == ["aa", "bb", "cc"] and (np.diag(field.transition) > field.transition.mean()).all()
    test = spark.createDataFrame([(i, make(x, 20), x) for i, x in enumerate(list(syllables) * 20)], "doc_id long, text string, lang string")
    assert identify(test, field).where("lang = lang_pred").count() >= 58
    mixed, _, _, _ = field.label(pa.array([make("aa", 30) + " " + make("bb", 10)]))
    assert mixed == ["aa"]
    got = identify(docs, field)
    assert set(got.columns) == {*docs.columns, "lang_pred", "second_score"}
    by = {r.doc_id: r for r in got.where("doc_id IS NOT NULL").collect()}
    assert [by[i].lang_pred for i in (0, 1, 2, 5)] == ["und"] * 4 and by[0].score == 0
    assert by[6].lang_pred != "und" and all(0 <= r.score <= 1 for r in by.values())
    assert identify(empty, field).count() == 0
    assert {r.lang_pred for r in identify(docs, Field([])).collect()} == {"und"}
    assert docs.select(queries.held_out().alias("h")).where("h IS NULL").count() == 0


def plain_line_dedup(data):
    texts = list(dict.fromkeys((r[0], r[1]) for r in data))
    first = {}
    for i, t in texts:
        x = (t or "").split("\n")
        for p in range(len(x) - 2):
            w, place = tuple(x[p : p + 3]), ((i is None, i or 0), t, p)
            if w not in first or place[0] < first[w][0] or (place[1] == first[w][1] and place < first[w]):
                first[w] = place
    out = {}
    for i, t in texts:
        if t is None:
            out[(i, t)] = (None, 0, 0)
            continue
        x = t.split("\n")
        gone = {p + o for p in range(len(x) - 2) for o in range(3) if first[tuple(x[p : p + 3])] != ((i is None, i or 0), t, p)}
        out[(i, t)] = ("\n".join(v for p, v in enumerate(x) if p not in gone), len(x), len(gone))
    return out


def test_line_dedup(docs, empty):
    from manifoldry.llm.lines import dedup_lines

    expected = plain_line_dedup(rows())
    marked = docs.withColumn("was", F.col("text"))
    got = dedup_lines(marked).collect()
    assert bag((r.doc_id, r.was, r.text, r.n_lines, r.n_removed) for r in got) == bag((r[0], r[1], *expected[(r[0], r[1])]) for r in rows())
    assert any(r.n_removed for r in got) and set(got[0].asDict()) == {*marked.columns, "n_removed"}
    assert dedup_lines(empty).count() == 0


def test_line_dedup_with_a_hot_window(spark, monkeypatch):
    from manifoldry.llm import common, lines

    monkeypatch.setattr(common, "COLD", 20)
    monkeypatch.setattr(common, "FILTER", 4)
    rng = random.Random(14)
    hot = "\n".join(" ".join(words(rng, 4)) for _ in range(4))
    data = [(i, f"{' '.join(words(rng, 5))}\n{hot}\nend {i}" if i % 3 == 0 else "\n".join(" ".join(words(rng, 2, 3)) for _ in range(6)), "en", "s", 1) for i in range(300)]
    expected = plain_line_dedup(data)
    got = lines.dedup_lines(spark.createDataFrame(data, SCHEMA).withColumn("was", F.col("text")).repartition(5)).collect()
    assert bag((r.doc_id, r.was, r.text, r.n_lines, r.n_removed) for r in got) == bag((r[0], r[1], *expected[(r[0], r[1])]) for r in data)


def test_licenses(docs, empty, spark):
    from manifoldry.llm.licenses import CONTAINED, TEMPLATES, scan_licenses

    rng = random.Random(5)
    extra = []
    for i, (_, t) in enumerate(TEMPLATES):
        w = t.split()
        cutdown = w.copy()
        if len(w) > 60:
            cutdown[len(w) // 2] = "changed"
        extra.append((1000 + i, " ".join(words(rng, 70) + cutdown + words(rng, 50))))
        extra.append((2000 + i, " ".join(w[: len(w) // 2])))
    given = docs.select("doc_id", "text", "k", "b").union(spark.createDataFrame(extra, "doc_id long, text string").select("doc_id", "text", F.lit("x"), F.lit("y")))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(w) - 4)}
    expected = {(i, j) for i, t in {*((r[0], r[1]) for r in rows()), *extra} for j, (_, x) in enumerate(TEMPLATES) if len(shingles(t) & shingles(x)) >= CONTAINED * len(shingles(x))}
    got = scan_licenses(given).collect()
    assert {(r.doc_id, r.template) for r in got} == expected and len(got) == len(expected)
    assert {1000 + i for i in range(len(TEMPLATES))} <= {r.doc_id for r in got}
    for r in got:
        if 1000 <= r.doc_id < 2000 and r.doc_id - 1000 == r.template:
            n = len(re.findall("[a-z0-9]+", TEMPLATES[r.template][1].lower()))
            assert (r.from_word, r.to_word) == (70, 70 + n)
    assert scan_licenses(empty).count() == 0
    mine = spark.createDataFrame([("mine", "my very own kind of license text")], "license string, text string")
    held = spark.createDataFrame([(1, "so under my very own kind of license text it is"), (2, "my very own")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.from_word, r.to_word) for r in scan_licenses(held, mine).collect()] == [(1, "mine", 2, 9)]
    assert scan_licenses(held, mine.limit(0)).count() == 0


def test_license_bands(spark):
    from manifoldry.llm.licenses import CONTAINED, MISS, SHINGLE, TEMPLATES, _span, least_similarity, n_bands

    lengths = [len(re.findall("[a-z0-9]+", t.lower())) for _, t in TEMPLATES]
    bands = n_bands(lengths, CONTAINED)
    rng, missed, tried = np.random.default_rng(3), 0, 0
    for n in (*lengths, 5, 6, 400):
        # a window with just the share of a template that makes a match, and strangers in all other places
        t, window = n - SHINGLE + 1, _span(n) - SHINGLE + 1
        held = int(np.ceil(CONTAINED * t - 1e-9))
        assert n <= _span(n) // 2 + 1 and abs(held / (t + window - held) - least_similarity(n, CONTAINED)) < 1e-12
        for _ in range(40):
            both, a, b = (rng.random((bands, x)).min(axis=1, initial=2) for x in (held, t - held, window - held))
            missed += not ((both < a) & (both < b)).any()
            tried += 1
    assert missed <= max(2, 10 * MISS * tried) and (1 - min(least_similarity(n, CONTAINED) for n in lengths)) ** bands <= MISS


def test_decontamination(spark, docs, empty):
    from manifoldry.llm.decontaminate import benchmark_hits, lcs

    assert lcs([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3 and lcs([1], []) == 0
    rng = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(100_000)}" for _ in range(n)]
    items = [(i, prose(rng.randint(16, 60))) for i in range(40)] + [(40, ["short", "item"]), (41, [])]
    data, truth = [], {}
    for i in range(300):
        text = prose(rng.randint(0, 400))
        if i % 3 == 0:
            j = rng.randrange(40)
            item = items[j][1].copy()
            if i % 2:  # a paraphrase: one word in ten left out or changed
                for p in range(4, len(item) - 5, 10):
                    item[p] = rng.choice(["", "changed"])
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", "."]) for w in item]
            truth[i] = j
        data.append((i, " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("benchmark_hits", F.lit(1))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(50, None), (None, "short item")], "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.benchmark_hits] for r in benchmark_hits(df, bench).collect()}
    assert {i: h for i, h in got.items() if h} == {i: [j] for i, j in truth.items()}
    turns = benchmark_hits(df, bench, keep=["doc_id"], turn_items=12)
    assert turns.columns == ["doc_id", "benchmark_hits"] and {r.doc_id: [h.item_id for h in r.benchmark_hits] for r in turns.collect()} == got
    assert all(len(r.benchmark_hits) == 0 for r in benchmark_hits(docs, bench).collect())
    assert benchmark_hits(empty, bench).count() == 0
    assert benchmark_hits(df, bench.where("item_id < 0")).where(F.size("benchmark_hits") > 0).count() == 0


def test_decontamination_in_repetitive_documents(spark):
    from manifoldry.llm.decontaminate import benchmark_hits

    rng = random.Random(12)
    common = [f"c{i}" for i in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(3000)}" for _ in range(n)]
    items = [prose(rng.randint(16, 60)) for _ in range(40)] + [rng.choices(common, k=20) for _ in range(3)] + [["c0"] * 9 + ["c1"], ["c2", "c3", "c4"]]
    data = [" ".join(prose(rng.randint(200, 400))) for _ in range(200)]
    for i, item in enumerate(items):
        word = rng.choice([f"r{rng.randrange(3000)}", f"odd{i}"])
        text = prose(200)
        text[100:100] = [word] * rng.randint(20, 40) + item + [word] * rng.randint(20, 40)
        data.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: {h.item_id for h in r.benchmark_hits} for r in benchmark_hits(df, bench, keep=["doc_id"]).collect()}
    assert [i for i in range(len(items)) if i not in got[200 + i]] == []


def test_decontamination_finds_what_a_search_of_all_pairs_finds(spark):
    from manifoldry.llm import decontaminate as D

    rng = random.Random(13)
    common = [f"c{i}" for i in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(400)}" for _ in range(n)]
    items = [prose(rng.randint(10, 40)) for _ in range(20)]
    data = []
    for i in range(120):
        text = prose(rng.randint(0, 150))
        if i % 2:
            item = [w for w in items[rng.randrange(20)]]
            for p in rng.sample(range(len(item)), rng.randint(0, len(item) // 4)):
                item[p] = rng.choice(common)
            at = rng.randint(0, len(text))
            text[at:at] = item
        data.append(text)
    truth = set()
    for i, text in enumerate(data):
        for j, item in enumerate(items):
            n, size = len(item), int(1.25 * len(item))
            for a in range(0, max(1, len(text) - size + 4), 4):
                part = text[a : a + size]
                if D.lcs(item, part) >= np.ceil(D.SHARE * n) and D.lcs(item[-D.ANSWER :], part) >= D.ANSWER_SHARE * D.ANSWER:
                    truth.add((i, j))
                    break
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(data)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, h.item_id) for r in D.benchmark_hits(df, bench).collect() for h in r.benchmark_hits}
    assert len(truth) > 40 and len(truth & got) >= 0.98 * len(truth)
    for i, j in got:
        assert D.lcs(items[j], data[i]) >= D.SHARE * len(items[j])


def test_latent_basis(spark):
    from manifoldry.llm import decontaminate as D

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    one, share = D.latent_basis(texts.coalesce(1))
    many, other = D.latent_basis(texts.repartition(7))
    assert np.array_equal(one, many) and np.array_equal(share, other)
    words, first = D._words(pa.array([r.text for r in texts.collect()]))
    feature = D._feature(words)
    runs, run = D._runs(feature, first, D.PASSAGE)
    a = np.zeros((len(runs), D.FEATURES), dtype=np.float32)
    np.add.at(a, (run, feature), 1)
    df = (a > 0).sum(axis=0)
    assert np.allclose(share, df / len(runs))
    idf = np.where(df > 0, np.log((1 + len(runs)) / (1 + df)) + 1, 0)
    a *= idf.astype(np.float32)
    spectrum = np.linalg.eigvalsh((a @ a.T).astype(np.float64))[::-1]
    q, _ = np.linalg.qr(one / np.where(idf > 0, idf, 1)[:, None])
    # of what the exact leading singular vectors hold of the variance
    assert np.linalg.norm(a @ q) ** 2 >= 0.85 * spectrum[: D.RANK].sum()


def test_quality(spark, docs, empty):
    from manifoldry.llm.quality import score_quality, train_classifier

    rng = random.Random(7)
    good = lambda: " ".join(words(rng, 60)).capitalize()
    poor = lambda: " ".join(w.upper() + "!!" for w in words(rng, 60))
    toxic = lambda: " ".join([*words(rng, 30), "vile", "rotten", *words(rng, 30)])
    kinds = [(good, 1, 0), (good, 1, 0), (good, 1, 0), (poor, 0, 0), (toxic, 1, 1)]
    made = [(i, f(), q, t, f"h{i % 7}", f"p{i % 3}") for i in range(1500) for f, q, t in [kinds[i % 5]]]
    df = spark.createDataFrame(made, "doc_id long, text string, quality int, toxic int, host string, path string")
    c = train_classifier(df.where("doc_id < 1000"), df)
    got = {r.doc_id: r for r in score_quality(df.where("doc_id >= 1000").withColumn("p", F.lit("clash")), c, F.col("host"), F.col("path")).collect()}
    right = [(got[i].keep, q == 1 and t == 0) for i, _, q, t, _, _ in made if i >= 1000]
    assert sum(a == b for a, b in right) >= 0.97 * len(right)
    out = score_quality(docs, c, F.col("source"), F.col("lang")).collect()
    assert len(out) == len(rows()) and all(0 <= r.quality <= 1 and r.keep is not None for r in out)
    # a bad host weighs on its documents, and a sparse one hardly
    sites = spark.createDataFrame([(i, good() if i % 10 else poor(), "clean", "x") for i in range(200)] + [(1000 + i, good() if i % 10 == 0 else poor(), "dirty", "x") for i in range(200)] + [(5000, poor(), "new", "x"), (5001, good(), "new", "x")], "doc_id long, text string, host string, path string")
    s = {r.doc_id: r for r in score_quality(sites, c, F.col("host"), F.col("path")).collect()}
    assert s[1].path_posterior > s[5001].path_posterior > s[1000].path_posterior
    assert train_classifier(df.where("doc_id < 0"), df) is None and train_classifier(df, df.where("doc_id < 0")) is None
    assert all(r.keep for r in score_quality(docs, None, F.col("source"), F.col("lang")).collect())
    assert score_quality(empty, c, F.col("source"), F.col("lang")).count() == 0


def test_quality_learns_from_long_and_repeated_rows(spark):
    from manifoldry.llm import quality

    rng = random.Random(8)
    long = lambda *more: " ".join([*words(rng, 40_000), *more])
    docs = [(i, long("vile") if i % 2 else long(), "x") for i in range(12)] + [(7, " ".join(words(rng, 9)), "x"), (None, "no id", "x"), (50, None, "x")]
    docs += [(100, "the same text", "x")] * 300
    labels = [(i, 1, i % 2) for i in range(12)] + [(i, 1, 1) for i in range(1000, 9000)] + [(100, 1, 0), (None, 0, 0), (50, 0, 0), (3, None, 1)] + [(100, 1, 0)] * 200
    seen = {}

    class Spy(quality.Classifier):
        def fit(self, texts, poor, toxic):
            seen.update({(t, bool(p), bool(x)): None for t, p, x in zip(texts.to_pylist(), poor, toxic)})
            assert len(seen) == len(texts)
            return self

    was, quality.Classifier = quality.Classifier, Spy
    try:
        df, marks = spark.createDataFrame(docs, "doc_id long, text string, h string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        quality.train_classifier(df, marks, sample=50)
        assert set(seen) == {(t, False, x == 1) for i, t, _ in docs for j, q, x in labels if i is not None and i == j and t is not None and q is not None}
        seen.clear()
        quality.train_classifier(df, marks, sample=5)
        assert len(seen) == 5
    finally:
        quality.Classifier = was


def test_site_posteriors_against_plain_moments(spark):
    from manifoldry.llm.quality import LEAST, MOST, site_posteriors

    rng = np.random.default_rng(10)
    for spread, inner in ((0.2, 0.1), (0.2, 0.0), (0.0, 0.0)):
        data = []
        for h in range(12):
            base = 0.5 + spread * rng.normal()
            for q in range(rng.integers(1, 6)):
                mean = base + inner * rng.normal()
                data += [(f"h{h}", f"p{q}", float(mean + 0.1 * rng.normal())) for _ in range(rng.integers(1, 30))]
        p = np.array([r[2] for r in data])
        host = np.unique([r[0] for r in data], return_inverse=True)[1]
        path = np.unique([f"{r[0]}/{r[1]}" for r in data], return_inverse=True)[1]
        of = np.array([host[path == j][0] for j in range(path.max() + 1)])
        mean_h, n_h = np.bincount(host, p) / np.bincount(host), np.bincount(host)
        mean_p, n_p = np.bincount(path, p) / np.bincount(path), np.bincount(path)
        in_host = ((p - mean_h[host]) ** 2).sum() / (len(p) - len(n_h))
        in_path = ((p - mean_p[path]) ** 2).sum() / (len(p) - len(n_p))
        v_host = ((n_h * (mean_h - p.mean()) ** 2).sum() - (len(n_h) - 1) * in_host) / (len(p) - (n_h**2).sum() / len(p))
        v_path = ((n_p * (mean_p - mean_h[of]) ** 2).sum() - (len(n_p) - len(n_h)) * in_path) / (len(p) - (np.bincount(of, n_p**2) / n_h).sum())
        expected = [np.clip(x / v if v > 0 else MOST, LEAST, MOST) for x, v in ((in_host, v_host), (in_path, v_path))]
        got = site_posteriors(spark.createDataFrame(data, "host string, path string, p double")).collect()
        assert len(got) == len(n_p)
        for r in got:
            assert np.allclose([r.prior, r.host_weight, r.path_weight], [p.mean(), *expected], rtol=1e-6)
            mine = [x for h, q, x in data if (h, q) == (r.host, r.path)]
            assert r.path_n == len(mine) and abs(r.path_total - sum(mine)) < 1e-9 and r.host_n == sum(1 for h, _, _ in data if h == r.host)
    one = site_posteriors(spark.createDataFrame([("h", "p", 0.5)], "host string, path string, p double")).first()
    assert one.host_weight == one.path_weight == MOST


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    spark.createDataFrame([(1, " ".join((rows()[22][1]).split()[100:140]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.createDataFrame(rows(), SCHEMA)
    one = P.language_id(spark, given, str(tmp_path))
    assert one.columns == given.columns and one.where("text IS NULL OR text = ''").count() == 0
    two = P.line_dedup(spark, given, str(tmp_path))
    assert two.columns == given.columns and two.count() == given.count()
    three = P.near_dedup(spark, given, str(tmp_path)).collect()
    fps = [plain_fingerprint(r[1]) for r in rows()]
    tops = least_of_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(three) == len(set(tops))
    least = {t: min((r[0] for r, u in zip(rows(), tops) if u == t and r[0] is not None), default=None) for t in tops}
    assert bag(r.doc_id for r in three) == bag(least.values())
    four = P.decontamination(spark, given, str(tmp_path))
    assert four.columns == given.columns and bag(r.doc_id for r in four.collect()) == bag(r[0] for r in rows() if r[0] != 22)
    five = P.sentencepiece(spark, given, str(tmp_path)).collect()
    assert len(five) == len(rows()) and all(r.round_trip for r in five)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_drops_near_copies(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    texts = []
    for _ in range(60):
        base = words(rng, rng.randint(40, 300))
        texts.append(base)
        for _ in range(rng.choice([0, 1, 2, 9])):
            copy = base.copy()
            for p in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 40))):
                copy[p] = "changed"
            texts.append(copy)
    texts += [["A", "b"], ["a", "B"], ["a", "c"], [], []]
    sets = [{tuple(w[i : i + 5]) for w in [" ".join(x).lower().split()] for i in range(max(1, len(w) - 4))} for x in texts]
    tops = least_of_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    given = spark.createDataFrame([(i, " ".join(x), "en", "s", 1) for i, x in enumerate(texts)], SCHEMA).repartition(3)
    got = dict(P.STAGES)["near_dedup"](spark, given, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted({t: min(i for i, u in enumerate(tops) if u == t) for t in tops}.values())


def test_near_copies_in_long_lists(spark):
    from manifoldry.llm.copies import near_copies

    # many texts that share nearly all, and pairs of others that share less with them than with each other
    rng = random.Random(15)
    base = words(rng, 120)
    texts = []
    for i in range(90):
        copy = base.copy()
        for p in rng.sample(range(120), 1 if i < 60 else 3):
            copy[p] = f"x{i}p{p}"
        texts.append(copy)
    far = [base[:100] + words(rng, 20) for _ in range(12)]
    texts += far + [x[:99] + ["other"] + x[100:] for x in far]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    tops = least_of_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)] * 2, "doc_id long, text string").repartition(5)
    root = {r.doc_id: r.root for r in near_copies(df).collect()}
    for i, j in combinations(range(len(texts)), 2):
        assert (tops[i] == tops[j]) == (root[i] == root[j])


def test_unjoined_pairs(spark):
    from manifoldry.llm.copies import hub_pairs, list_sizes, open_nodes, shared_lists, unjoined, with_hubs

    many = list(range(10, 20))
    listed = [(1, x) for x in many] + [(1, 10)] + [(2, x) for x in (10, 11)] + [(3, x) for x in range(100, 112)] + [(4, 500)] * 3 + [(5, 105), (5, 600)]
    roots = {x: 10 for x in many[1:-3]} | {x: 105 for x in range(100, 112)}
    df = spark.createDataFrame(listed, "t long, node long").repartition(3)
    sizes = list_sizes(df)
    assert {(r.t, r.n) for r in sizes.collect()} == {(1, 11), (2, 2), (3, 12), (5, 2)}
    shared = with_hubs(shared_lists(df, sizes))
    assert shared.count() == 27 and {(r.t, r.hub) for r in shared.select("t", "hub").distinct().collect()} == {(1, 10), (2, 10), (3, 105), (5, 105)}
    assert {(r.a, r.b) for r in hub_pairs(shared).collect()} == {(10, x) for x in many[1:]} | {(105, x) for x in range(100, 112) if x != 105} | {(105, 600)}
    still = open_nodes(shared, spark.createDataFrame(list(roots.items()), "node long, root long"))
    assert {(r.node, r.root) for r in still.collect()} == {(x, roots.get(x, x)) for x in many}
    lists = [(1, 11), (1, 12), (1, 17), (2, 17), (2, 18), (2, 11), (3, 12), (3, 13), (4, 19), (9, 999)]
    sized = spark.createDataFrame([(t, x, 100, 88 if x == 12 else 90) for t, x in lists], "t long, node long, size long, used long")
    assert {(r.a, r.b) for r in unjoined(sized, still, 0.8).collect()} == {(11, 17), (17, 18), (11, 18)}


def test_prefixes_hold_every_similar_pair(spark):
    from manifoldry.llm.copies import prefixes

    rng = random.Random(25)
    base = list(range(150))
    sets = []
    for i in range(120):
        x = set(base)
        for p in rng.sample(base, rng.randint(0, 60)):
            x.discard(p)
            if rng.random() < 0.8:
                x.add(1000 + rng.randrange(400) if i % 2 else 10_000 + 1000 * i + p)
        sets.append(x)
    df = spark.createDataFrame([(i, h) for i, x in enumerate(sets) for h in x], "node long, h long").repartition(4)
    lists, found = {}, {}
    for r in prefixes(df, 0.8).collect():
        lists.setdefault(r.t, set()).add(r.node)
        found[r.node] = (r.size, r.used)
    assert all(found[i] == (len(sets[i]), sum(any(h in y for j, y in enumerate(sets) if j != i) for h in sets[i])) for i in found)
    able = lambda a, b: min(found[a][1], found[b][1]) * 1.8 >= 0.8 * (found[a][0] + found[b][0]) - 1e-6
    met = {(a, b) for x in lists.values() for a, b in combinations(sorted(x), 2)}
    near = {(i, j) for i, j in combinations(range(120), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near <= {p for p in met if able(*p)} and len(near) > 100 and len(met) < 120 * 119 / 2 * 0.7


def test_similarities_of_pairs(spark):
    from manifoldry.llm.copies import shingle_sets, similarities

    rng = random.Random(23)
    base = words(rng, 60)
    texts = [" ".join(base[:i] + words(rng, 60 - i)) for i in range(0, 60, 5)] + ["", "one word"]
    node, sets = shingle_sets(pa.array(texts), 5)
    df = spark.createDataFrame([(t, i, 10 * i) for i, t in enumerate(texts)] * 3, "text string, p long, q long").repartition(4)
    firsts = spark.createDataFrame([(int(x), i, 10 * i) for i, x in enumerate(node)], "node long, p long, q long")
    pairs = [(i, j) for i in range(12) for j in range(12) if i < j and (i + j) % 3] + [(3, 13), (13, 0)]
    got = similarities(spark.createDataFrame([(int(node[i]), int(node[j])) for i, j in pairs], "a long, b long"), firsts, df, 5).collect()
    expected = {(int(node[i]), int(node[j])): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in pairs}
    assert {(r.a, r.b): r.s for r in got} == expected and len(got) == len(pairs)


def test_near_copies_around_an_original(spark):
    from manifoldry.llm.copies import near_copies

    # copies that are near their original alone
    rng = random.Random(24)
    base = words(rng, 200)
    texts = [base]
    for _ in range(60):
        copy = base.copy()
        for p in rng.sample(range(200), 4):
            copy[p] = f"x{rng.random()}"
        texts.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    assert sum(len(a & b) >= 0.8 * len(a | b) for a, b in combinations(sets[1:], 2)) < 200 and all(len(a & sets[0]) >= 0.8 * len(a | sets[0]) for a in sets[1:])
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert len({r.root for r in near_copies(df).collect()}) == 1


def test_join_by_counts(spark, monkeypatch):
    from manifoldry.llm import common

    monkeypatch.setattr(common, "COLD", 50)
    monkeypatch.setattr(common, "HOT", 8)
    rng = random.Random(16)
    left = [(rng.choice([0, 0, 0, *range(1, 400)]) if i % 3 else 0, i) for i in range(2000)]
    n = Counter(k for k, _ in left)
    right = spark.createDataFrame([(k, c, f"v{k}") for k, c in n.items() if k != 7], "k int, n int, v string")
    for cold in (50, 5000):
        monkeypatch.setattr(common, "COLD", cold)
        got = common.join_by_counts(spark.createDataFrame(left, "k int, i int"), right, ["k"], "n", "i")
        assert got.columns == ["k", "i", "n", "v"] and bag((r.k, r.i, r.v) for r in got.collect()) == bag((k, i, f"v{k}") for k, i in left if k != 7)


def test_sift(spark):
    from manifoldry.llm.common import sift

    df = spark.range(2000).select(F.xxhash64("id").alias("h"), "id")
    known = df.where("id % 50 = 0").select("h")
    may, rest = sift(df, known, "h")
    assert may.columns == rest.columns == ["h", "id"] and may.count() + rest.count() == 2000
    assert {r.id for r in may.collect()} >= set(range(0, 2000, 50)) and may.count() < 60
    assert sift(df, known.limit(0), "h")[0].count() == 0


def test_pipeline_run(spark):
    import corpus_pipeline as P

    out = P.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(out) <= 200 and len({r.doc_id for r in out}) == len(out) and all(r.round_trip for r in out)


def test_queries_and_sql(spark):
    import duckdb

    from manifoldry.llm.queries import QUERIES, SQL

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, d)
        columns = sorted(got.columns)
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert bag(map(tuple, got.select(*columns).collect())) == bag(expected), name
