import numpy as np
import pyarrow as pa
import pytest

from sparkweave.llm import toxicity


def test_evidence_sums_all_significant_segments(spark):
    toxic, clean = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)
    vile, mild = (int(next(toxicity.slots(pa.array([w]), 20))[0]) for w in ("vile", "mild"))
    toxic[vile], clean[mild] = 1000, 1000
    m = toxicity.Model(20, 3.0, 1.5, toxic, clean)
    m.lam, m.k, m.a, m.b = 1.0, 1e-3, -5.0, 1.0
    docs = spark.createDataFrame([(1, "vile mild mild mild " * 40)], "doc_id long, text string")
    r = toxicity.score(docs, m).first()
    assert len(r["segments"]) == 40
    assert r["evidence"] == pytest.approx(sum(m.lam * s["score"] - np.log(m.k * r["n_words"]) for s in r["segments"]))


def test_training_takes_all_segments_too(spark):
    """Toxic texts of one and of 40 passages: the curve's evidence is that of the whole texts."""
    rows = [(k, "mild kind " * 50, 0) for k in range(40)] + [(100 + k, ("vile foul " + "mild kind " * 6) * (40 if k % 2 else 12), int(k % 4 > 0)) for k in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    x = []
    for _, t, y in rows:
        s = next(toxicity.slots(pa.array([t]), m.bits))
        x.append(m.evidence(len(s), [v for v, _, _ in toxicity.segments(m.odds(s, y))]))
    assert (m.a, m.b) == pytest.approx(toxicity.fit_logistic(np.log1p(np.array(x)), np.array([float(r[2]) for r in rows])), rel=1e-3)
