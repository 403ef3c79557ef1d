"""Texts and signals of the reports are made once for fitting and for the vectors, which stay the same."""

from faultline.operators import features as FE
from faultline.operators.splits import split_reports
from faultline.plans import training


def test_report_columns_are_made_once(tiny, tiny_config, monkeypatch):
    calls, make = [], FE.ReportColumns._transform
    monkeypatch.setattr(FE.ReportColumns, "_transform", lambda self, df: calls.append(1) or make(self, df))
    data = training.prepare_vectors(tiny, tiny_config)
    assert len(calls) == 1
    split = split_reports(training.prepare_supervised(tiny, 1), tiny_config)
    model, metadata = FE.fit_features(split.filter("split = 'train'"), tiny_config)
    rows = lambda df: sorted((r.report_id, r.split, r.text_vec.toArray().tolist(), r.full_vec.toArray().tolist()) for r in df.collect())
    assert metadata == data.metadata
    assert rows(data.vectors) == rows(FE.featurise(split, model, "report_id", "split"))
