from types import SimpleNamespace

from lakeprofile.catalog import pipelines


def test_the_query_searches_the_whole_grid(spark, monkeypatch):
    class Search:
        def __init__(self, estimator, estimatorParamMaps, **_):
            self.grid = estimatorParamMaps

        def fit(self, _):
            return SimpleNamespace(getEstimatorParamMaps=lambda: self.grid, avgMetrics=[0.5] * len(self.grid))

    monkeypatch.setattr(pipelines.train, "CrossValidator", Search)
    monkeypatch.setattr(pipelines.train, "_vectors", lambda rows: rows)
    monkeypatch.setattr(pipelines, "_checkpointed_columns", lambda spark, sf: None)
    found = {(r.num_trees, r.max_depth) for r in pipelines._column_name_search(spark, "").collect()}
    assert found == {(t, d) for t in (5, 10, 20) for d in (5, 7)}
