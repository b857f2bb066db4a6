"""The registered searches run at full size; only tests pass smaller numbers."""

import inspect

import pytest

from churnkit.plans import ml_queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, bases", [("u3_build_final", ["forest"]), ("u4_end_to_end", ["forest", "gbt"])])
def test_every_base_is_searched_at_full_size(spark, monkeypatch, name, bases):
    calls = []

    def short_search(train, feats, make, grid, n_iter, label, id_col, k, balance):
        calls.append(("gbt" if make is q._make_gbt else "forest", grid, n_iter, k))
        for ends in (0, -1):
            make({c: v[ends] for c, v in grid.items()})  # every end of the grid is accepted
        best = {c: v[0] for c, v in grid.items()} | {"n_estimators": 3, "max_depth": 2}
        return best, spark.createDataFrame([(0, repr(sorted(best.items())), 0.5)], "trial int, params string, cv_score double")

    monkeypatch.setattr(q, "random_search", short_search)
    assert getattr(q, name)(spark, SF).count() > 0
    grids = {"forest": q.FOREST_GRID, "gbt": q.GBT_GRID}
    assert calls == [(b, grids[b], 30, 5) for b in bases]


def test_the_size_can_be_passed():
    for f in (q.u1_random_search, q.u2_bounded_search, q.u3_build_final, q.u4_end_to_end, q.run_end_to_end):
        size = inspect.signature(f).parameters
        assert (size.get("n_iter") or size["n_trials"]).default == 30 and size["k"].default == 5
