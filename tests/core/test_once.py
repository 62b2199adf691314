"""What all points' neighbours cost is paid once, however often the graph made of them is read."""

import os
import uuid

import pytest

from manifoldry.operators import geodesics as D
from manifoldry.plans.spectral import laplacian_eigenmaps


def ring(spark, n, folder):
    """Neighbours on a ring, in four tasks; each time a task looks for them leaves a file."""

    def search(batches):
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        yield from batches

    rows = [(i, r + 1, (i + s) % n, 1.0 + 0.25 * r) for i in range(n) for r, s in enumerate((1, n - 1))]
    return spark.createDataFrame(rows, "id long, rank int, other long, sq double").repartition(4).mapInArrow(search, "id long, rank int, other long, sq double")


def test_geodesics_search_once(spark, tmp_path):
    found = D.shortest_from(D.neighbour_graph(ring(spark, 12, str(tmp_path))), [0]).collect()
    assert {r.node: r.d for r in found} == {i: min(i, 12 - i) for i in range(12)}
    assert len(os.listdir(tmp_path)) == 4


def test_isomap_searches_once(spark, tmp_path):
    z = {r.id: r.z for r in D.isomap(ring(spark, 12, str(tmp_path)), [0, 3, 6], 2).collect()}
    assert len(z) == 12 and len(os.listdir(tmp_path)) == 4


def test_eigenmaps_search_once(spark, tmp_path):
    edges = D.neighbour_graph(ring(spark, 12, str(tmp_path)))
    z = {r.id: r.z for r in laplacian_eigenmaps(edges, 2).collect()}
    # a ring's first two axes are a circle
    assert [z[i][0] ** 2 + z[i][1] ** 2 for i in range(12)] == pytest.approx([z[0][0] ** 2 + z[0][1] ** 2] * 12)
    assert len(os.listdir(tmp_path)) == 4
