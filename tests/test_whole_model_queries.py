"""Model queries take every model feature."""

import pytest

import checks.models as queries
from checks import CHECKS
from marketloom.plans import model_frame as mf


@pytest.mark.parametrize("name", ["m04_ridge_coefficients", "m06_forest_regressor", "m07_forest_classifier", "m13_permutation_importance"])
def test_query_takes_every_feature(name, monkeypatch):
    """The query is stopped where it assembles its vectors."""
    class Reached(Exception):
        pass

    def stop(frame, features):
        raise Reached(features)
    monkeypatch.setattr(queries, "imputed", lambda spark, sf, features=None: features or mf.MODEL_FEATURES)
    monkeypatch.setattr(queries.train, "with_vector", stop)
    with pytest.raises(Reached) as reached:
        CHECKS[name].run(None, "")
    assert reached.value.args[0] == mf.MODEL_FEATURES and len(mf.MODEL_FEATURES) == 62
