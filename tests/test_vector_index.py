"""The pivot index against the search over all chunks."""

from __future__ import annotations

import numpy as np
import pytest

from quillmark.operators import search as S, vector_index as V

SCHEMA = "id long, embedding array<float>, note string"


def clusters(rng, n, width=8, centres=12):
    middle = rng.normal(size=(centres, width))
    return middle[rng.integers(0, centres, n)] + rng.normal(0, 0.05, (n, width))


@pytest.mark.parametrize("k", [1, 7, 100])
def test_the_same_as_all_chunks(spark, tmp_path, k):
    rng = np.random.default_rng(3)
    vectors = clusters(rng, 2000)
    rows = [(i, [float(x) for x in v.astype(np.float32)], "n") for i, v in enumerate(vectors)]
    rows += [(3000, None, "none"), (3001, [0.0] * 8, "zero"), (3002, [1.0] * 5, "other"), (3003, rows[5][1], "again"), (3004, [float("nan")] * 8, "nan")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    V.build_index(df, str(tmp_path / "index"))
    for query in (rows[5][1], rng.normal(size=8).tolist(), [0.0] * 8):
        found = V.indexed_topk(spark, str(tmp_path / "index"), query, k)
        pairs = lambda x: [(r["id"], r["note"], None if r["distance"] is None else round(r["distance"], 12)) for r in x.collect()]
        assert pairs(found.rows) == pairs(S.vector_topk(df, query, k)) and found.total == len(rows)
        if query == rows[5][1] and k < 100:
            assert found.read < 0.3 * found.total


def test_few_and_no_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "b"), (3, [0.0, 0.0], "c")], SCHEMA)
    V.build_index(df, str(tmp_path / "few"))
    assert [r["id"] for r in V.indexed_topk(spark, str(tmp_path / "few"), [1.0, 1.0], 5).rows.collect()] == [1, 2, 3]
    V.build_index(df.filter("id > 1"), str(tmp_path / "none"))
    assert [r["id"] for r in V.indexed_topk(spark, str(tmp_path / "none"), [1.0, 1.0], 5).rows.collect()] == [2, 3]
