"""The registered fits run every variant and the whole manifest."""

import pytest

from barloom.plans import modeling as M
from checks import model_queries as Q


class Asked(Exception):
    pass


class Rows:
    def filter(self, _):
        return self


@pytest.fixture
def asked(spark, monkeypatch):
    seen = {}

    def note(name, *args, **named):
        seen[name] = (args, named)
        raise Asked

    monkeypatch.setattr(Q, "dataset", lambda spark, sf_dir: Rows())
    monkeypatch.setattr(Q, "cut_lineage", lambda rows: rows)
    monkeypatch.setattr(Q.D, "feature_columns", lambda data: list(Q.FEATURES))
    for name in ("feature_set_walk_forward", "train_direction", "train_final"):
        monkeypatch.setattr(Q.M, name, lambda *a, name=name, **b: note(name, *a, **b))
    return seen


def test_subgroup_ablation_runs_every_variant_and_year(asked):
    with pytest.raises(Asked):
        Q.subgroup_ablation(None, "")
    (_, variants, years, *_), _ = asked["feature_set_walk_forward"]
    assert list(variants) == list(M.subgroup_variants(Q.FEATURES)) and len(variants) == 26
    assert list(years) == list(range(1995, 2003))


@pytest.mark.parametrize("query, fit", [("predict_multi_horizon", "train_direction"), ("generate_signals", "train_final")])
def test_single_fits_use_the_whole_manifest(asked, query, fit):
    with pytest.raises(Asked):
        Q.QUERIES[query](None, "")
    args, named = asked[fit]
    assert named.get("features") is None and Q.FEATURES not in args
