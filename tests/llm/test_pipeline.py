"""Registered queries of the corpus operators, and each pipeline stage on its own input."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_llm import brute_similar, frame  # noqa: E402
from test_queries import DATA, check  # noqa: E402

import corpus_pipeline  # noqa: E402
from amountlake.llm.common import materialize, settle  # noqa: E402
from amountlake.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if "text" in docs.columns else {}
        docs = materialize(stage(spark, docs, str(DATA)), "stage")
        after = docs.collect()
        seen.append(len(after))
        if name == "SimHash near-dedup":
            ids = sorted(before)
            root = brute_similar([before[i].text for i in ids])[1]
            assert sorted(r.doc_id for r in after) == sorted({ids[x] for x in root})
        if name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            bad = {i for i, r in before.items() if any(t in r.text for t in items)}
            assert bad and not bad & {r.doc_id for r in after} and len(before) - len(after) <= 2 * len(bad)
        if name == "token files":
            assert sum(r.n_tokens for r in after) == max(r.start + r.n_tokens for r in after) and len(after) == seen[-2]
        else:
            assert docs.columns == columns and {r.doc_id for r in after} <= set(before)
    assert seen[1] >= 0.97 * seen[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "source mixing", "token files"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, rows without an id and clashing columns go through every stage; so does an empty table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.filter("doc_id < 3").collect()}
    leaked = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(1000, None, None, None), (1001, "", "en", "s"), (None, text[0], "en", "src0"), (None, f"{text[1]} {leaked}", "en", "src0"), (0, text[0], "en", "src0"), (1002, "123 456", None, "s"), (1003, " \n ", None, None)]
    odd = docs.select(*["doc_id", "text", "lang", "source", "n_chars"]).filter("doc_id < 60").unionByName(frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"))
    for name in ("row", "_k", "_t", "key", "copies", "c", "score", "label"):
        odd = odd.withColumn(name, F.lit("clash"))
    for case, table in (("odd", odd), ("empty", odd.limit(0))):
        (tmp_path / case).mkdir()
        table.write.parquet(f"{tmp_path}/{case}/documents.parquet")
        (tmp_path / case / "benchmark.parquet").symlink_to(DATA / "benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{case}").collect()
        ids = [r.doc_id for r in got]
        assert not {1000, 1001, 1002, 1003} & set(ids) and (None in ids) is False and (len(ids) > 20) == (case == "odd")
        assert sum(r.n_tokens for r in got) == max((r.start + r.n_tokens for r in got), default=0)


def test_stages_begin_with_heap_given_back(spark, monkeypatch):
    """What one stage took of an executor's memory is not added to by the next."""
    said = []
    monkeypatch.setattr(corpus_pipeline, "settle", lambda session: said.append(session) or settle(session))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(50)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:3:2], 1):
        assert stage(spark, docs, str(DATA)).count() > 0 and len(said) == n
