"""The registered queries against SQL, and the pipeline stage by stage against plain versions."""

import hashlib
import itertools

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from geoledger.llm import toxicity
from geoledger.llm.alignment import within
from geoledger.llm.oracle import ORACLE
from geoledger.llm.queries import QUERIES
from geoledger.session import cut

SF = "/root/testdata/sf0.001"


def _plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    checked = sql.execute(ORACLE[name])
    place = [[c[0] for c in checked.description].index(c) for c in df.columns]
    assert _plain(df.collect()) == _plain([[r[k] for k in place] for r in checked.fetchall()])


def test_everything_is_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name,rows", [("op1_toxicity", 200), ("op4_quality_classifier", 200), ("op5_order_minhash", 200), ("op8_page_diff", 50), ("op10_gru_lm", 200)])
def test_queries_return_every_row(spark, sf_dir, name, rows):
    assert QUERIES[name](spark, sf_dir).count() == rows


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], SF)))
    return tables


def test_stages_keep_the_columns_of_documents(stages):
    assert all(t.dtypes == stages[0].dtypes for t in stages[1:-1])


def test_toxic_stage_drops_what_the_models_reject(spark, stages):
    trained = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.score_toxicity(stages[0], trained).where("predicted = 0").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept and kept


def _words(text):
    return (text or "").encode().split()


def test_near_copy_stage_keeps_one_of_each_group(stages):
    before, after = ({r.doc_id: _words(r.text) for r in t.collect()} for t in stages[1:3])
    codes = {}
    numbered = {i: np.array([codes.setdefault(x, len(codes)) for x in w], dtype=np.uint32) for i, w in before.items() if w}
    pairs = list(itertools.combinations(sorted(numbered), 2))
    parent = {i: i for i in before}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for (i, j), near in zip(pairs, within([(numbered[i], numbered[j]) for i, j in pairs], 0.2)):
        if near:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    smallest = {i for i in before if find(i) == i}
    assert smallest <= set(after) and len(set(after) - smallest) <= 1  # all that is alone stays; recall is not quite 1
    assert all(after[i] == before[i] for i in after)


def test_substring_stage_cuts_what_smaller_documents_hold(stages):
    before, after = ({r.doc_id: _words(r.text) for r in t.collect()} for t in stages[2:4])
    seen = set()
    for i in sorted(before):
        w = before[i]
        own = [tuple(w[p:p + 50]) for p in range(len(w) - 49)]
        gone = [False] * len(w)
        for p, key in enumerate(own):
            if key in seen:
                gone[p:p + 50] = [True] * 50
        seen.update(own)
        assert after[i] == [x for x, g in zip(w, gone) if not g]
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_decontamination_stage_drops_documents_with_items(spark, stages):
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: " ".join(r.text.split()) for r in stages[3].collect()}
    after = {r.doc_id for r in stages[4].collect()}
    holding = {i for i, t in before.items() if any(x in t for x in items if len(x.split()) >= 13)}
    assert not holding & after and len(before) - len(after) <= len(holding) + 5


def test_packing_stage_covers_what_is_left(spark, stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[4].collect()}
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) + 1
    again = corpus_pipeline.run(spark, SF).collect()
    digest = lambda part: hashlib.md5(repr(sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in part)).encode()).hexdigest()
    assert digest(rows) == digest(again)
