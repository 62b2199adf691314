"""Processors with state by key, for transformWithStateInPandas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Quota(StatefulProcessor):
    """The first `most` rows of a key."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        taken = self.taken.get()[0] if self.taken.exists() else 0
        for f in rows:
            some = f.head(max(0, self.most - taken))
            taken += len(some)
            if len(some):
                yield some[["cell", "id"]]
        self.taken.update((taken,))

    def close(self) -> None:
        pass


class Reservoir(StatefulProcessor):
    """The n rows of least place of a key, and how many it has had."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.kept = handle.getListState("kept", "place string, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.seen.get()[0] if self.seen.exists() else 0
        kept = [(r[0], r[1]) for r in self.kept.get()] if self.kept.exists() else []
        for f in rows:
            seen += len(f)
            # n rows and a batch at most
            kept = sorted([*kept, *zip(f["place"], f["id"].tolist())])[: self.n]
        self.seen.update((seen,))
        self.kept.put(kept)
        yield pd.DataFrame({"part": [key[0]] * len(kept), "seen": [seen] * len(kept), "place": [p for p, _ in kept], "id": [i for _, i in kept]})

    def close(self) -> None:
        pass
