"""Nearest neighbours at the parameters of the query, where a third of the rows are copies or one cluster."""

import collections

import numpy as np
import pytest

from seqspark.llm import vectors


@pytest.mark.parametrize("width", [0.0, 1e-3])
def test_recall_with_a_third_in_one_place(spark, width):
    rnd = np.random.default_rng(6)
    m = rnd.normal(size=(4000, 64))
    third = rnd.permutation(4000)[:1333]
    m[third] = m[third[0]] + width * rnd.normal(size=(1333, 64))
    near = collections.defaultdict(list)
    for r in sorted(vectors.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")).collect(), key=lambda r: r["rank"]):
        near[r.query_id].append(r.vec_id)
    hits = {True: [], False: []}
    for a in range(0, 4000, 100):
        d = np.sqrt(((m - m[a]) ** 2).sum(axis=1))
        want = [b for b in np.lexsort((np.arange(4000), d)) if b != a][:10]
        hits[a in third].append(len(set(near[a]) & set(want)) / 10)
        if a in third and not width:
            assert near[a] == want  # among equal distances the smaller ids
    assert np.mean(hits[True]) >= 0.95 and np.mean(hits[False]) >= 0.9


def test_exact_top_k_of_components_of_any_size(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, (rnd.normal(size=6) * 10.0 ** rnd.choice([0, 3, 6])).tolist()) for i in range(150)]
    rows[50] = (50, [2.0**18, 1.0, 0.0, -3.0, 0.5, 0.25])
    rows += [(7, rows[7][1]), (8, [1.0, 2.0]), (9, []), (None, [1.0] * 6), (10, None), (11, [float("nan")] * 6), (200, [None] * 6), (201, rows[100][1]), (202, rows[100][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, block string, rank int")
    sound = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and not any(x is None or np.isnan(x) for x in v)]
    want = []
    for q, x in sound:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in sound if i != q)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert any(abs(s) > 2**53 for *_, s in want) and any(abs(s) < 2**53 for *_, s in want)
    # Scores above 2**63 are an error; without the row that makes them there are none.
    with pytest.raises(Exception, match="64 bits"):
        vectors.exact_top_k(df.unionByName(spark.createDataFrame([(300, [2.0**60] * 6, "x", 1)], df.schema))).collect()
    assert sorted(tuple(r) for r in vectors.exact_top_k(df).collect()) == sorted(want)


def test_searches_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for search in (vectors.exact_top_k, vectors.nearest):
        assert search(spark.createDataFrame([], schema)).count() == 0
        assert search(spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)).count() == 0  # no query
        got = search(spark.createDataFrame([(100, [1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (100, [1.0])], schema)).collect()
        assert [(r.query_id, r.vec_id) for r in got] == [(100, 1)] * 4


def test_recall_on_the_given_table(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the given tables aren't here")
    df = spark.read.parquet(path)
    ids, m = zip(*((r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()))
    ids, m = np.array(ids), np.array(m, np.float64)
    near = collections.defaultdict(set)
    for r in vectors.nearest(df).collect():
        near[r.query_id].add(r.vec_id)
    recall = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((m - m[q]) ** 2).sum(axis=1)
        want = [ids[i] for i in np.lexsort((ids, d)) if i != q][:10]
        recall.append(len(near[ids[q]] & set(want)) / 10)
    assert np.mean(recall) >= 0.9
