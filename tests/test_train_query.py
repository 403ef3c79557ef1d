"""The training query stores the model that it compares and picks, and predicts with the stored one."""

from faultline.plans import model_queries
from faultline.operators.models import predict_labels


def test_train_pipeline_predicts_with_the_stored_bundle(spark, trained, tiny, tiny_config, monkeypatch):
    loaded = []
    load = model_queries.load_bundle
    monkeypatch.setattr(model_queries, "reports", lambda *_: tiny)
    monkeypatch.setattr(model_queries, "CONFIG", tiny_config)
    monkeypatch.setattr(model_queries, "load_bundle", lambda path, s: loaded.append(load(path, s)) or loaded[-1])
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(model_queries.QUERIES["train_pipeline"](spark, ""))
    assert [b.model_name for b in loaded] == [trained.bundle.model_name] and loaded[0].labels == trained.prepared.labels
    data = trained.prepared
    assert found and found == rows(predict_labels(data.split("test"), trained.bundle.classifier, data.labels, "report_id"))
