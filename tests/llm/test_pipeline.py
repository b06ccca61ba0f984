"""The pipeline: each stage on its own input against plain versions, and odd tables through all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from headway.llm import bpe, decontaminate, jaccard, quality, secret_scan
from headway.llm.tables import stored, table

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        new = stored(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, new))
        docs = new
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    assert all(new.columns == COLUMNS for _, new in stages[:-1])
    assert "token_ids" in stages[-1][1].columns


def test_quality_stage_drops_what_the_classifier_rejects(spark, stages):
    before, after = stages[0]
    verdict = quality.quality(before, table(spark, SF, "labels")).where("predicted = 1")
    assert ids(after) == ids(verdict)
    good = table(spark, SF, "labels").where("quality = 1")
    assert len(ids(good) & ids(before) - ids(after)) <= 2


def test_near_duplicate_stage_keeps_the_first_of_each_group(stages):
    before, after = stages[1]
    groups = jaccard.jaccard_groups(before).collect()
    assert ids(after) == {r.component_id for r in groups}
    assert after.count() == len(ids(after))


def test_decontamination_stage_drops_leaks(spark, stages):
    before, after = stages[2]
    leaked = ids(decontaminate.leaks(before, table(spark, SF, "benchmark")))
    assert leaked and ids(after) == ids(before) - leaked


def test_secret_stage_masks_and_keeps_every_document(stages):
    before, after = stages[3]
    assert ids(after) == ids(before)
    old = {r.doc_id: r.text for r in before.collect()}
    path = secret_scan.default_path()
    for r in after.collect():
        spans = secret_scan.find(old[r.doc_id], path)
        assert r.text == secret_scan.mask(old[r.doc_id], spans)
        assert r.n_chars == len(r.text)
        assert spans or r.text == old[r.doc_id]


def test_token_stage_encodes_every_document(stages):
    before, after = stages[4]
    v = bpe.vocabulary(bpe.default_path())
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.token_ids == np.frombuffer(v.encode(texts[r.doc_id]), "<u4").tolist() and r.n_tokens == len(r.token_ids)


def test_run_is_the_stages_in_order(spark, stages):
    cols = ["doc_id", "n_tokens"]
    assert sorted(map(tuple, P.run(spark, SF).select(cols).collect())) == sorted(map(tuple, stages[-1][1].select(cols).collect()))


def test_odd_and_empty_tables_go_through(spark, docs):
    rows = [(1, None), (2, ""), (3, "plain words of a clean text that stays " * 4), (3, "plain words of a clean text that stays " * 4), (None, "plain words of a clean text that stays " * 4), (4, "x " * 30000), (None, None)]
    odd = docs(rows).withColumn("node", F.lit("n")).withColumn("quality", F.lit(1)).withColumn("item_id", F.array(F.lit(1)))
    for df in (odd, docs([])):
        for name, stage in P.STAGES:
            new = stored(stage(spark, df, SF), f"odd-{name}")
            if name != "tokens":
                assert new.columns == df.columns
            df = new
        assert df.columns[0] == "doc_id"
