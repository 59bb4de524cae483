import corpus_pipeline as cp
from mediarec.llm.common import read
from mediarec.operators.staging import stage


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    columns, rows = docs.columns, [docs.count()]
    for name, step in cp.STAGES[:-1]:
        docs = stage(step(spark, docs, sf), "pipeline-test")
        assert docs.columns == columns, name
        rows.append(docs.count())
    assert rows == sorted(rows, reverse=True) and rows[2] == rows[3] and rows[-1] > 0.6 * rows[0]
    out = cp.STAGES[-1][1](spark, docs, sf)
    assert out.where("piece = 0").count() == rows[-1]


def test_awkward_rows(spark, sf, awkward, nothing):
    for docs in (awkward, nothing):
        for name, step in cp.STAGES[:-1]:
            docs = stage(step(spark, docs, sf), "pipeline-test")
            assert docs.columns == awkward.columns, name
        cp.STAGES[-1][1](spark, docs, sf).count()
