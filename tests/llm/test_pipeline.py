"""The pipeline, stage by stage, against plain versions on the smallest tables."""

from collections import Counter

import brute
import duckdb
import pytest
from test_near_copies import brute as near_groups

import corpus_pipeline
from tessera.llm import oracle, quality_rules
from tessera.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into each stage, and what comes out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[0].count() > steps[1].count() > steps[2].count() >= steps[3].count() > 0


def test_quality(spark, steps):
    verdict = quality_rules.apply_rules(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(steps[1]) == ids(verdict.where("kept"))


def test_near_dedup(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].select("doc_id", "text").collect()]
    assert ids(steps[2]) == sorted({c for _, c in near_groups(rows)})


def test_decontaminate(spark, steps):
    rows = [(r.doc_id, r.text) for r in steps[2].select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.leaks(rows, items)}
    assert ids(steps[3]) == sorted(i for i, _ in rows if i not in bad)


def test_mix(steps):
    documents = steps[3].toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    mixed = con.sql(oracle.ORACLE["op1_mix"]).df()
    times = {i: int(taken / max(size, 1) + 0.5) for i, taken, size in zip(mixed.doc_id, mixed.taken, mixed["size"], strict=True)}
    assert Counter(ids(steps[4])) == Counter({i: n for i, n in times.items() if n})


def test_shard(steps):
    out = steps[5].toPandas()
    assert sorted(out.doc_id) == ids(steps[4])
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert set(out["shard"]) <= set(range(16))
