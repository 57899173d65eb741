"""Queries against their SQL on keys of larger tables, and steps that must not grow with them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from amountlake.functions import normalize
from amountlake.operators import corpus, decode
from amountlake.plans.registry import ORACLE_SQL, QUERIES


def _check(spark, name, folder, table, rows):
    """The query's rows are its SQL's, over a table of the given rows."""
    con = duckdb.connect()
    con.sql(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, str(folder))
    assert sorted(map(tuple, found.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("first", [4_990, 119_900, 7_199_900])
def test_checked_lines_of_large_values(spark, tmp_path, first):
    _check(spark, "q_checked_lines", tmp_path, "part", f"SELECT i AS p_partkey FROM range({first}, {first} + 60) r(i)")


def test_claims_off_by_rupees():
    line = lambda text, value: corpus.check_line({"text": f"usne {text} diye", "lang": "hi_latn", "phrases": [{"phrase": text, "value": value, "range": None}]})[0]
    assert line("6000k", 6_000_005.0) == "value_mismatch" and line("6000k", 6_000_000.0) is None
    assert line("7200 crore", 72_000_000_001.0) == "value_mismatch" and line("7200 crore", 7200 * 1e7) is None
    assert line("2.3456789 crore", 23456789.0) is None and line("1234567890.55", 1234567890.55) is None  # evaluation rounds to whole rupees here
    assert line("0.1 lakh", 0.1 * 1e5) is None and line("350.9 kharab", 350.9 * 1e11) is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stitched_without_sorts(spark, tmp_path):
    names = "CASE WHEN i % 7 = 0 THEN NULL WHEN i % 7 = 1 THEN '' WHEN i % 7 = 2 THEN repeat('é😀क़', 40) ELSE 'Customer#' || i END"
    _check(spark, "q_stitched", tmp_path, "customer", f"SELECT i AS c_custkey, {names} AS c_name FROM range(5399900, 5400000) r(i)")
    plan = _plan(QUERIES["q_stitched"](spark, str(tmp_path)))
    assert "Exchange" not in plan and "Sort" not in plan  # memory of a task is that of a row


@pytest.mark.parametrize("size, overlap", [(8, 3), (8, 7), (5, 0), (128, 16)])
def test_stitched_is_stitch(spark, size, overlap):
    """Arrays of windows and sorted characters give the same texts."""
    df = spark.createDataFrame([(n, "".join(chr(0x900 + (n * i) % 97) if i % 3 else "x" for i in range(n))) for n in (1, 4, 5, 7, 8, 9, 12, 13, 14, 127, 128, 129, 240, 241, 500)], "k int, text string")
    cut = df.select("k", normalize.windows(F.col("text"), size, overlap).alias("w"))
    chars = cut.select("k", F.inline("w")).select("k", "offset", F.posexplode(F.split("text", "")).alias("at", "char")).filter("char <> ''").withColumn("pos", F.col("offset") + F.col("at"))
    rows = normalize.stitch(chars, ["k"]).groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "char"))), lambda x: x.char), "").alias("text"))
    want = {r.k: r.text for r in df.collect()}
    assert {r.k: r.text for r in cut.select("k", normalize.stitched(F.col("w")).alias("text")).collect()} == want == {r.k: r.text for r in rows.collect()}


@pytest.mark.parametrize("name", ["q_decode_range", "q_decode_word", "q_decode_cut"])
def test_decode_queries_on_all_cores(spark, tmp_path, name):
    """A file of one row group is not one task's work."""
    _check(spark, name, tmp_path, "part", "SELECT i AS p_partkey FROM range(7199900, 7200900) r(i)")
    sizes = QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 500


def test_words_of_a_text_are_found_once(spark, monkeypatch):
    """Characters looked at grow with the text, not with the text times its spans."""
    seen = []
    kept = decode.runs
    monkeypatch.setattr(decode, "runs", lambda text, start=0, end=None: seen.append(len(text[start:end])) or kept(text, start, end))
    text = "kul 12 lakh " * 300
    classes = (["O"] * 4 + ["DIGITS"] * 2 + ["SEP"] + ["UNIT_LAKH"] * 4 + ["O"]) * 300
    found = decode.decode(text, ([0] * 4 + [1] + [2] * 6 + [0]) * 300, classes)
    assert len(found) == 300 and sum(seen) < 10 * len(text)


def test_remembered_spans_are_the_same():
    import numpy as np
    import pandas as pd

    text, bio = "5 lakh", [1, 2, 2, 2, 2, 2]
    rows = [["DIGITS", "SEP", *["UNIT_LAKH"] * 4], ["DIGITS", "SEP", *["UNIT_CRORE"] * 4], ["DIGITS", "SEP", *["UNIT_LAKH"] * 3, "O\nO"], ["O\nDIGITS", "SEP", *["UNIT_LAKH"] * 4]]
    rows = [rows[i % 4] for i in range(12)]
    got = decode._decoded(pd.Series([text] * 12), pd.Series([np.array(bio)] * 12), pd.Series([np.array(r, dtype=object) for r in rows]))
    for r, spans in zip(rows, got):
        assert [(s["start"], s["end"], s["classes"]) for s in spans] == [(w[0][2], w[-1][3], [x[0] for x in w if x[0] != "SEP"]) for w, _ in decode.decode(text, bio, r)]


def _parts_by_runs(text):
    """The rule read run by run."""
    from amountlake.operators import tagger

    out, before, left = [], [], 0
    for run in tagger._RUN.finditer(text):
        role = "" if run.group().isspace() else tagger._role(run.group())
        if role == "number":
            if not left:
                start = before[-6] if len(before) >= 6 else 0
                if out and start <= out[-1][1]:
                    out[-1][1] = len(text)
                else:
                    out.append([start, len(text)])
            left = 6
        elif role == "word":
            before.append(run.start())
            left -= bool(left)
            if out and out[-1][1] == len(text) and not left:
                out[-1][1] = run.end()
    out = [(text.rfind(" ", 0, a) + 1, b if text.find(" ", b) < 0 else text.find(" ", b)) for a, b in out]
    return [p for i, p in enumerate(out) if not i or out[i - 1][1] < p[0]] if all(x[1] < y[0] for x, y in zip(out, out[1:])) else None


def test_parts_of_a_text_by_distinct_words(monkeypatch):
    """Words of a long text are told apart once each, and parts are where six words without a number cut them."""
    from amountlake.operators import tagger

    asked = []
    kept = tagger._role
    monkeypatch.setattr(tagger, "_role", lambda run: asked.append(run) or kept(run))
    text = ("zqa zqb zqc zqd zqe zqf zqg 5 lakh — zqh zqi zqj zqx zqv zqm zqn " + "zqo, zqp " * 6 + "२ ² " + "zqr zqs. " * 4) * 500
    parts = tagger._stretches(text)
    assert len(asked) < 40 and parts == _parts_by_runs(text) and len(parts) > 500
    assert tagger._stretches("nothing here — at all. " * 500) == []
