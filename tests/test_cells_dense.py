"""Triangles of large dense cells, as top separators are."""

import time

import numpy as np
import pandas as pd

from conftest import SMALL
from roadloom import catalog
from roadloom.operators import cells
from roadloom.operators import hierarchy as h
from roadloom.plans import structure


def clique(n):
    lo, hi = np.triu_indices(n, 1)
    r = np.random.default_rng(5)
    part = pd.DataFrame({"lo": lo, "hi": hi, "up": r.integers(1, 10_000, len(lo)).astype(float), "down": r.integers(1, 10_000, len(lo)).astype(float)})
    part.loc[r.random(len(lo)) < 0.3, "up"] = None
    return part


def test_a_dense_cell_is_customized_by_arrays():
    n, part = 600, clique(600)
    want = np.full((n, n), np.inf)
    np.fill_diagonal(want, 0)
    want[part["lo"], part["hi"]], want[part["hi"], part["lo"]] = part["up"].fillna(np.inf), part["down"]
    for v in range(n):
        want = np.minimum(want, want[:, v, None] + want[v])
    start = time.process_time()
    found = h._through_higher(set(range(n - 1)), h._through_lower(set(range(n - 1)), part))
    spent = time.process_time() - start
    assert (found["up"].astype("float64").fillna(np.inf) == want[found["lo"], found["hi"]]).all()
    assert (found["down"].astype("float64").fillna(np.inf) == want[found["hi"], found["lo"]]).all()
    assert len(found) == len(part)
    print(f"{spent:.1f} s")
    assert spent < 8  # one triangle at a time takes tens of seconds


def test_cells_are_found_once_for_all_customizations(spark, monkeypatch):
    monkeypatch.setattr(structure, "_built", {})
    edges = structure.completed(spark, SMALL).count()
    monkeypatch.setattr(cells, "next_cells", None)
    assert catalog.queries()["cch_customized"](spark, SMALL).count() == edges
    assert catalog.queries()["cch_directed"](spark, SMALL).count() > 0
