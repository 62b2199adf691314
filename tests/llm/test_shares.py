"""The share of a hit is the largest of all places where the item stands, whatever the order of the search."""

import random

from manifoldry.llm.decontaminate import benchmark_hits


def test_best_share_of_several_places(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choices(words, k=rng.randrange(20, 60))) for _ in range(12)]
    docs, want = [], {}
    for i, item in enumerate(items):
        w = item.split()
        most = [w[:k] + [rng.choice(words)] + w[k + 1 :] for k in (2, 5)]
        worse = [x if k not in (1, 4, 7) else rng.choice(words) for k, x in enumerate(w)]
        filler = lambda: rng.choices(words, k=200)
        # a place with three words changed, then one with one, then in every other document the whole
        parts = [worse, most[0], *([w] if i % 2 else [])]
        rng.shuffle(parts)
        docs.append((i, " ".join(x for p in parts for x in (*filler(), *p)) + " end"))
        want[i] = 1.0 if i % 2 else (len(w) - 1) / len(w)
    df = spark.createDataFrame([*docs, *((100 + k, " ".join(rng.choices(words, k=300))) for k in range(30))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = []
    for cosine in (0.4, 2.0):
        rows = benchmark_hits(df, bench, cosine=cosine).collect()
        found.append({(r.doc_id, h.item_id): h.share for r in rows for h in r.benchmark_hits})
    assert found[0] == found[1]
    assert all(found[0][i, i] >= want[i] for i in want)
