"""The pipeline on a small table against the same decisions by brute force, and its stages one by one."""

from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import awkward, documents
from tests.llm.test_other_operators import labelled
from tests.llm.test_text_operators import components_by_force, fingerprint_by_force, lines_by_force, windows_by_force, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs, labels = labelled(spark)
    rows = [*docs[:60], *((10_000 + d if d is not None else None, t) for d, t in awkward(5))]
    documents(spark, rows, clash=False).write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], sf_dir)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    rows = [[(r["doc_id"], r["text"]) for r in t.collect()] for t in tables[:5]]
    assert set(rows[1]) < set(rows[0])
    # lines
    assert Counter((d, t or "") for d, t in rows[2]) == Counter({(d, t): n for (d, _, _, t), n in lines_by_force(rows[1]).items()})
    # near-duplicates
    root = components_by_force(rows[2], [fingerprint_by_force(t) for _, t in rows[2]])
    assert {d for d, _ in rows[3]} == {d for d in {d for d, _ in rows[2]} if d is None or root[d] == d}
    # passages
    kept = defaultdict(list)
    for d, _, _, t in windows_by_force(rows[3], 35).elements():
        kept[d].append(t)
    assert all(" ".join(words(t)) in kept[d] for d, t in rows[4]) and len(rows[4]) == len(rows[3])
    # packing holds every document
    packed = tables[5].collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in rows[4]}


def test_run_equals_stages(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir).collect()
    per = defaultdict(int)
    for r in out:
        per[r["sequence_id"]] += r["length"]
    assert out and max(per.values()) <= 1024 and corpus_pipeline.ORACLE_SQL is None
