"""Calibration, metrics, corpus jobs, sources, streams and synthetic lines."""

import json

import pytest
from pyspark.sql import functions as F

from amountlake.functions import calibration, normalize
from amountlake.operators import corpus, metrics, synth
from amountlake.operators.parse import parse_df
from amountlake.sources import files
from amountlake.streaming import amounts as streams


def test_pav():
    assert calibration.pav([1, 2, 4, 3, 5]) == [1, 2, 3.5, 3.5, 5]
    assert calibration.pav([3, 2, 1]) == [2, 2, 2]
    assert calibration.pav([1, 0], [1, 9]) == [0.1, 0.1]


def test_fit_isotonic(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.5, 1), (None, 1)], "raw double, correct int")
    assert calibration.fit_isotonic(df) == ([0.1, 0.2, 0.3, 0.4, 0.5], [0, 0.5, 0.5, 1, 1])
    tied = spark.createDataFrame([(0.8, 1), (0.8, 0), (0.9, 1)], "raw double, correct int")
    assert calibration.fit_isotonic(tied) == ([0.8, 0.9], [0.5, 1])


def test_interpolate(spark):
    df = spark.createDataFrame([(0.6,), (0.8,), (0.0,), (1.0,), (None,)], "r double")
    got = [r[0] for r in df.select(calibration.calibrate(F.col("r"), ([0.5, 0.7, 0.9], [0.1, 0.6, 0.9]))).collect()]
    assert got[:4] == pytest.approx([0.35, 0.75, 0.1, 0.9]) and got[4] is None
    assert calibration.fit_breakpoints([], []) == ([0.0, 1.0], [0.0, 1.0])
    xs, ys = calibration.fit_breakpoints([i / 100 for i in range(100)], [i // 5 / 20 for i in range(100)], most=8)
    assert len(xs) <= 8 and ys == sorted(ys)


def test_normalization(spark):
    df = spark.createDataFrame([("Café १२",), ("ક૫",), (None,), ("ऩ",)], "t string")
    assert [r[0] for r in df.select(normalize.normalize_text(F.col("t"))).collect()] == ["café 12", "ક5", None, "ऩ"]
    one = spark.createDataFrame([("  a \t b  ", 1234567)], "t string, n long")
    assert one.select(normalize.clean(F.col("t")), normalize.dedup_key(F.lit("A-b, C!")), normalize.indian_grouping(F.col("n"))).first()[:] == ("a b", "abc", "12,34,567")
    texts = spark.createDataFrame([("ab",), ("b1",)], "text string")
    assert [tuple(r) for r in normalize.charset(texts).orderBy("id").collect()] == [("1", 2), ("a", 3), ("b", 4)]


def _line(text, phrases, lang="hi_latn", n=1):
    return (text, lang, None if phrases is None else [dict(zip(("phrase", "value", "range"), p)) for p in phrases], "f", n)


LINES = [
    (_line("usne 20k diye", [("20k", 999999.0, None)]), "value_mismatch"),
    (_line("zoop lakh mile", [("zoop lakh", 1e5, None)]), "unknown_token:zoop"),
    (_line("usne Rs.4,500 diye", [("Rs.4,500", 4500.0, None)]), None),
    (_line("35-lakh ka", [("35-lakh", 3500000.0, None)]), None),
    (_line("5000 aur 45000", [("5000", 5000.0, None)]), None),
    (_line("saadhe teen baje aana", []), None),
    (_line("unnees sau lakh baat", []), "negative_contains_quantity"),
    (_line("ek baat", None), "missing_phrases"),
    (_line("", []), "missing_text"),
    (_line("5 lakh", [("5 lakh", 5e5, None)], "xx"), "lang_mismatch"),
    (_line("5 lakh aur 5 lakh", [("5 lakh", 5e5, None)]), "ambiguous_phrase"),
    (_line("2-3 lakh", [("2-3 lakh", 2e5, [2e5, 3e5])]), None),
    (_line("5 lakh mile", [("6 lakh", 6e5, None)]), "phrase_not_found"),
    (_line("5 lakh mile", [("5 lakh", None, None)]), "missing_value"),
]


def test_checked_lines(spark):
    rows = [(*x[0][:4], i) for i, x in enumerate(LINES)]
    rows += [(*_line("usne Rs.4,500 diye", [("Rs.4,500", 4500.0, None)])[:4], 50), (*_line("sona 5 lakh", [("5 lakh", 5e5, None)])[:4], 51)]
    df = spark.createDataFrame(rows, "text string, lang string, phrases array<struct<phrase:string,value:double,range:array<double>>>, src_file string, src_line int")
    gold = spark.createDataFrame([("SONA 5 lakh",)], "text string")
    got = {r.src_line: r for r in corpus.verify_lines(df, gold).collect()}
    for i, (_, reason) in enumerate(LINES):
        assert got[i].reason == reason, LINES[i]
    assert got[50].reason == "dup" and got[51].reason == "dup_gold"
    assert [(s.start, s.end, s.currency) for s in got[2].spans] == [(8, 13, "INR")]
    assert {r.reason: r.n for r in corpus.reject_histogram(corpus.verify_lines(df, gold)).filter("lang = 'xx'").collect()} == {"lang_mismatch": 1}


def test_corpus_jobs(spark):
    df = spark.createDataFrame([(1, "aaj mausam bahut accha", "hi_latn", "a"), (2, "Aaj mausam, bahut accha!", "hi_latn", "b"), (3, "flat 20k mein hai", "hi_latn", "a"), (4, "!!", "hi_latn", "a"), (5, "woh kal jaayega", "hi_latn", "a")], "id int, text string, lang string, source string")
    assert sorted(r.id for r in corpus.first_by_key(df, ["id"]).collect()) == [1, 3, 5]
    scored = corpus.score_lines(df, "id")
    assert {r.id: (r.score, r.positive) for r in scored.collect()}[3] == (4, True)
    negatives = corpus.build_negatives(scored, spark.createDataFrame([("woh kal jaayega",)], "text string"), 5)
    assert "woh kal jaayega" not in {r.text for r in negatives.collect()} and negatives.count() >= 2
    assert corpus.hash_sample(df, 2, "s").collect() == corpus.hash_sample(df, 2, "s").collect()
    variants = corpus.mine_variants(spark.createDataFrame([("लाख", "Lakkh", 3), ("घर", "ghar", 9)], "native string, roman string, n int"), spark.createDataFrame([("lakh",)], "surface string"))
    assert [tuple(r) for r in variants.collect()] == [("UNIT_LAKH", "lakkh", 3)]
    assert [r[0] for r in spark.range(1).select(corpus.char_labels(F.lit(5), F.lit(1), F.lit(3))).collect()] == [[0, 1, 2, 0, 0]]


def test_metrics(spark):
    cats = spark.createDataFrame([(["CARD_2", "UNIT_LAKH", "UNIT_SAU"], "do lakh sau", False, None), (["DIGITS", "UNIT_HAZAAR"], "20k", True, "INR")], "c array<string>, t string, r boolean, m string")
    got = [r[0] for r in cats.select(metrics.categories(F.col("c"), F.col("t"), F.col("r"), F.col("m"))).collect()]
    assert got == [["words", "multi_unit"], ["digits", "range", "currency", "symbol_unit"]]
    table = spark.createDataFrame([("f", "a", 0.5), ("f", "b", 0.7)], "file string, model string, value_accuracy double")
    assert metrics.matrix(table).first()[:] == ("f", 0.5, 0.7)
    reports = metrics.triage(spark.createDataFrame([("5 lakh", 500000.0), ("5 lakh", 1.0)], "text string, expected_value double")).collect()
    assert [r.reproduces for r in reports] == [False, True] and json.loads(reports[0].gold_line)["spans"][0]["value"] == 500000
    runs = [("a", 0.9343, 0.952, 0, 1), ("a", 0.9338, 0.956, 0, 2), ("a", 0.9346, 0.950, 0, 3)]
    assert metrics.winner(spark.createDataFrame(runs, "config string, val double, f1 double, fp int, place int")).first()["place"] == 2


def test_synthetic_round_trip(spark):
    df = synth.generate(spark, 300, seed=5)
    assert df.collect() == synth.generate(spark, 300, seed=5).collect()
    right = F.size(F.filter("spans", lambda s: F.exists("amounts", lambda a: (a["start"] == s["start"]) & (a["end"] == s["end"]) & (a["value"] == s["value"]))))
    n, ok = parse_df(df).agg(F.sum(F.size("spans")), F.sum(right)).first()
    assert n > 200 and ok / n > 0.9
    import random

    assert synth.noise("hazaar", random.Random(1)) and synth.to_script("12", "hi_deva") == "१२"


def test_sources(spark, tmp_path):
    import gzip

    (tmp_path / "a.tsv").write_text("x\tdo lakh\ny\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("ek \nteen\n")
    (tmp_path / "g.jsonl").write_text('{"text": "5 Lakh", "lang": "hi_latn", "spans": []}\n\n{broken\n')
    spark.createDataFrame([(("haan",),), (("",),)], "translation struct<hi_en:string>").write.parquet(str(tmp_path / "c.parquet"))
    assert [r.text for r in files.read_tsv_second(spark, str(tmp_path / "a.tsv")).collect()] == ["do lakh"]
    assert [r.text for r in files.read_lines(spark, str(tmp_path / "b.txt.gz"), 2).orderBy("text").collect()] == ["ek", "teen"]
    assert [r.text for r in files.read_parquet_field(spark, str(tmp_path / "c.parquet")).collect()] == ["haan"]
    gold = files.read_jsonl(spark, str(tmp_path / "g.jsonl"))
    assert gold.count() == 2 and gold.filter("_corrupt_record is not null").count() == 1
    assert [r.text for r in files.gold_texts(spark, str(tmp_path / "g.jsonl")).collect()] == ["5 lakh"]
    numbered = files.read_numbered(spark, [str(tmp_path / "g.jsonl")])
    assert [r.src_line for r in numbered.orderBy("src_line").collect()] == [1, 3]
    source = files.Source("t", "hi_latn", "a.tsv", "tsv2")
    assert files.load_all(spark, [source, source], str(tmp_path), limit=1).count() == 2
    checked = spark.createDataFrame([("hi_latn", None), ("hi_latn", "dup"), ("hi_latn", "unknown_token:x")], "lang string, reason string")
    made = files.merge_manifest(checked, str(tmp_path / "m.json"), [str(tmp_path / "a.tsv")])
    assert made["hi_latn"] == {"total": 3, "accepted": 1, "rejects": {"dup": 1, "unknown_token": 1}}
    files.write_jsonl(checked, str(tmp_path / "out"), ["lang"])
    assert "| 1 |" in files.markdown(spark.createDataFrame([(1,)], "n int"))


def test_streams(spark, tmp_path):
    spark.createDataFrame([("5 lakh", "2024-01-01 00:00:00"), ("20k", "2024-01-01 00:01:00")], "text string, ts string").selectExpr("text", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.write_amounts(streams.parse_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(a.value for r in got.collect() for a in r.amounts) == [20000, 500000]
    assert streams.distinct_lines(stream, "ts", "1 hour").isStreaming and streams.windowed_totals(stream, "ts", "1 hour", "1 hour").isStreaming
