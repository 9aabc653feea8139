import numpy as np
import pytest

from recordmill.llm.embedding_dedup import near_vectors, planes, tables_for, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, least=0.95):
    """Every pair compared, then the smallest id reachable."""
    good = [k for k, (_, v) in enumerate(rows)
            if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    near = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (unit(np.array([rows[x][1]], np.float32))[0] for x in (i, j))
                if float(a @ b) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[k][0], len(near[k]), component, rows[k][0] == component))
    return sorted(out, key=repr)


def sample(seed=1, n=260, dim=24):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dim) for _ in range(n)]
    for size in (2, 3, 5, 70):  # groups of near copies, one of them large
        centre = rng.standard_normal(dim)
        rows += [centre + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.2]) for _ in range(size)]
    chain = rng.standard_normal(dim)
    for _ in range(12):  # each like the next, the ends unlike
        chain = chain + rng.standard_normal(dim) * 0.2
        rows.append(chain.copy())
    order = rng.permutation(len(rows))
    made = [(int(i) * 3, [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]
    made += [(9000 + k, made[k][1]) for k in range(20)]  # exact copies
    return made + [(1, None), (2, []), (4, [0.0] * dim), (5, [None] + [1.0] * (dim - 1)), (7, [float("nan")] * dim),
                   (8, [float("inf")] + [0.0] * (dim - 1)), (10, [1e30] * dim), (11, [1e-30] * dim), (13, [1.0] * (dim + 1)),
                   (None, made[0][1]), (None, None), (made[1][0], made[1][1]), (14, [-0.0] * dim)]


@pytest.mark.parametrize("sizes", [{}, {"bucket": 2, "block": 8}])
def test_as_when_every_pair_is_compared(spark, sizes):
    rows = sample()
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).selectExpr("*", "1 as node", "vec_id as first", "2 as n")
    got = sorted((tuple(r) for r in near_vectors(frame, recall=0.99999, **sizes).collect()), key=repr)
    want = [(*w[:3], w[2] == w[0]) for w in expected(rows)]
    assert got == want
    assert max(w[1] for w in want) > 30


def test_tables_reach_the_recall_they_promise():
    """Pairs exactly at the least cosine, the hardest ones, share a bucket nearly always."""
    rng = np.random.default_rng(5)
    signs, tables = tables_for(100_000)
    a = unit(rng.standard_normal((4000, 64)))
    b = rng.standard_normal((4000, 64))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    met = np.zeros(4000, bool)
    for t in range(tables):
        d = planes(64, signs, t)
        met |= ((a @ d > 0) == (b @ d > 0)).all(axis=1)
    assert met.mean() > 0.995
    assert tables_for(0)[0] == 6 and tables_for(10**9)[0] > signs


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = near_vectors(spark.createDataFrame([(3, None, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in rows] == [(3, 0, 3, True)]
