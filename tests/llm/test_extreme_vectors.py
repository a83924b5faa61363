"""Vectors whose squares overflow or vanish link like any other."""

import numpy as np
import pytest

from marketloom.llm import lattice


def test_very_large_and_very_small_vectors_link(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=16)
    near = x + rng.normal(size=16) * 0.01
    rows = [(1, x * 1e200), (2, x * 1e200), (3, x * 1e-200), (4, near), (5, rng.normal(size=16)), (6, np.zeros(16)), (7, x * 1e-315)]
    vectors = spark.createDataFrame([(i, v.tolist(), "a") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.similar_vectors(vectors).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (0, 5), 6: (0, 6), 7: (4, 1)}


def test_ordinary_vectors_keep_their_bits():
    x = np.random.default_rng(7).normal(size=(50, 8))
    assert all((lattice.unit_vector(v) == v / np.linalg.norm(v)).all() for v in x)
    assert lattice.unit_vector(np.array([3e300, 4e300])) == pytest.approx([0.6, 0.8])
