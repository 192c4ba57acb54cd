import re
from collections import Counter

from tests.llm.fixtures import SCHEMA, prose

import corpus_pipeline
from tidewatch.llm import mixing, quality

SPACE = re.compile("[\x20\x09-\x0d]")


def test_stages_in_order(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    rows = [(i, prose(i, 100), "en", f"s{i % 3}", 1) for i in range(30)]
    near = rows[3][1].split(" ")
    rows += [(30, rows[0][1].replace(" ", "\n"), "en", "s0", 1), (31, " ".join([*near[:50], "other", *near[51:]]), "en", "s1", 1), (32, "too short", "en", "s1", 1), (33, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == before.columns
        ids = Counter(r.doc_id for r in docs.collect())
        if k == 0:
            assert set(ids) == set(range(32))
        elif k == 1:
            assert set(ids) == set(range(31 + 1)) - {30} or set(ids) == set(range(32)) - {0}
        elif k == 2:
            assert not {3, 31} <= set(ids) and len(ids) == 30
        elif k == 3:
            assert max(ids.values()) <= 2
            assert Counter(r.doc_id for r in mixing.mixed_documents(before).collect()) == ids
        else:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
            assert sum(1 for r in docs.collect() if r.piece == 0) == before.count()
    assert quality.keep_good(spark.read.parquet(str(tmp_path / "documents.parquet"))).count() == 32
