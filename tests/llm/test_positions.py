"""The positions at which sets meet leave out pairs, and never a similar one."""

import random
from itertools import combinations

from manifoldry.llm.copies import prefixes, unjoined


def test_pairs_by_position(spark):
    rng = random.Random(31)
    base = list(range(160))
    sets = []
    for i in range(140):
        x = set(base)
        for p in rng.sample(base, rng.randint(0, 70)):
            x.discard(p)
            x.add(1000 + rng.randrange(300) if rng.random() < 0.5 else 10_000 + 1000 * i + p)
        sets.append(x)
    df = spark.createDataFrame([(i, h) for i, x in enumerate(sets) for h in x], "node long, h long").repartition(4)
    alone = spark.createDataFrame([(i, i) for i in range(140)], "node long, root long")
    met = prefixes(df, 0.8)
    every = {(r.a, r.b) for r in unjoined(met.drop("pos"), alone, 0.8).collect()}
    by_place = {(r.a, r.b) for r in unjoined(met.selectExpr("t", "node", "size", "used - pos AS used"), alone, 0.8).collect()}
    near = {(i, j) for i, j in combinations(range(140), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(near) > 50 and near <= by_place <= every and len(by_place) < 0.7 * len(every)
