"""The toxicity field is fitted where its sample is, not on the driver."""

from __future__ import annotations

import numpy as np

from quakeframe.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_texts_do_not_reach_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = toxicity.fit(toxicity.sample(docs, labels))
    monkeypatch.setattr(toxicity, "sample", None)
    got = toxicity.train(docs, labels)
    assert got.weight == want.weight and np.array_equal(got.step, want.step) and np.array_equal(got.score, want.score) and got.constant == want.constant
    assert toxicity.train(docs.limit(0), labels).constant == 0
