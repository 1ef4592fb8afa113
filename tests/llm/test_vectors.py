"""Vector links against all pairs."""

import numpy as np
import pytest

import brute
from topicloom.llm import metricjoin as M


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.5) for i, v, l in rows], "vec_id bigint, embedding array<float>, label int, gap double")


def wanted(rows):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {k: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for k, (_, v, l) in enumerate(rows) if ok(v) and l is not None}
    links = [(a, b) for a in unit for b in unit if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    root = brute.roots([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    return sorted((rows[k][0], sum(a == k for a, _ in links), root[rows[k][0]]) for k in range(len(rows)))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    points = [c + rng.normal(size=8) * s for c in centres for s in (0.05, 0.1, 0.2, 0.3) for _ in range(6)]
    rows = [(int(i), [float(x) for x in p], int(i) % 3) for i, p in enumerate(points)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]  # copies of one vector
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [1.0, None], 1), (2004, rows[5][1], None),
             (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1), (2008, [1e30] * 8, 2), (2009, [1.0] * 8, 2)]
    return rows


@pytest.mark.parametrize("cell, block", [(M.CELL, M.BLOCK), (10, 7)])
def test_links(spark, rows, monkeypatch, cell, block):
    monkeypatch.setattr(M, "CELL", cell)
    monkeypatch.setattr(M, "BLOCK", block)
    got = M.vector_links(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == wanted(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_rows(spark):
    assert M.vector_links(table(spark, [])).count() == 0
