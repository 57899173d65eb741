"""Sources and sinks as Spark readers and writers."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import normalize_text

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("range", T.ArrayType(T.DoubleType())),
        T.StructField("currency", T.StringType()),
        T.StructField("unit", T.StringType()),
    ]
)
GOLD = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType = GOLD) -> DataFrame:
    """One object per line; blank lines go, broken ones have ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(paths).filter("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    return parsed.select("x.*")


def read_tsv_second(spark: SparkSession, path: str) -> DataFrame:
    """text: the second of tab-separated fields, of lines with two or more."""
    fields = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(fields) >= 2).select(fields[1].alias("text"))


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """text of plain or gzip files; a gzip file is one task, so its rows are spread if asked."""
    df = spark.read.text(path).select(F.rtrim("value").alias("text"))
    return df.repartition(partitions) if partitions else df


def read_parquet_field(spark: SparkSession, path: str, field: str = "translation.hi_en") -> DataFrame:
    """text: one nested field; only that column is read."""
    return spark.read.parquet(path).select(F.col(field).alias("text")).filter("text <> ''")


def read_numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """src_file, src_line (from 1, in file order), value of text files.

    Whole files are one record each here, as only that keeps line numbers; for files of many GB read lines instead.
    """
    whole = spark.read.text(sorted(paths), wholetext=True).select(F.col("_metadata.file_path").alias("src_file"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return whole.filter("trim(value) <> ''").select("src_file", (F.col("n") + 1).alias("src_line"), "value")


def gold_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """text: distinct normalized texts of gold files."""
    return read_jsonl(spark, paths).filter("text is not null").select(normalize_text(F.col("text")).alias("text")).distinct()


@dataclass(frozen=True)
class Source:
    """A corpus: where it is, how it is read, and under what terms."""

    id: str
    lang: str
    path: str
    kind: str
    url: str = ""
    licence: str = ""
    redistributable: bool = False
    note: str = ""


KINDS = {"tsv2": read_tsv_second, "lines": read_lines, "parquet": read_parquet_field}
CATALOG = (
    Source("wiki_hi", "hi_deva", "wiki_hi.txt.gz", "lines", licence="CC BY-SA", redistributable=True, note="sentences of an encyclopedia"),
    Source("wiki_mr", "mr_deva", "wiki_mr.txt.gz", "lines", licence="CC BY-SA", redistributable=True, note="sentences of an encyclopedia"),
    Source("wiki_gu", "gu_gujr", "wiki_gu.txt.gz", "lines", licence="CC BY-SA", redistributable=True, note="sentences of an encyclopedia"),
    Source("roman_hi", "hi_latn", "roman_hi.tsv", "tsv2", licence="CC BY-SA", redistributable=True, note="native and romanised sentences"),
    Source("chat_hi", "hi_latn", "chat_hi.parquet", "parquet", note="translations in a nested field"),
)


def load(spark: SparkSession, source: Source, root: str, limit: int | None = None) -> DataFrame:
    """text, lang, source of one source; at most ``limit`` lines if given."""
    df = KINDS[source.kind](spark, f"{root}/{source.path}")
    df = df.limit(limit) if limit else df
    return df.select("text", F.lit(source.lang).alias("lang"), F.lit(source.id).alias("source"))


def load_all(spark: SparkSession, sources: list[Source], root: str, limit: int | None = None) -> DataFrame:
    out = load(spark, sources[0], root, limit)
    for s in sources[1:]:
        out = out.unionByName(load(spark, s, root, limit))
    return out


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def merge_manifest(checked: DataFrame, path: str, files: list[str]) -> dict:
    """Totals and reject counts per language and digests of the files, merged into a JSON manifest."""
    from ..operators.corpus import reject_histogram

    made = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    for row in reject_histogram(checked).collect():
        entry = made.setdefault(row["lang"] or "", {"total": 0, "accepted": 0, "rejects": {}})
        if row["reason"]:
            entry["rejects"][row["reason"]] = row["n"]
        else:
            entry["accepted"] = row["n"]
    for entry in made.values():
        if "rejects" in entry:
            entry["total"] = entry["accepted"] + sum(entry["rejects"].values())
    made.setdefault("files", {}).update({Path(f).name: hashlib.sha256(Path(f).read_bytes()).hexdigest() for f in files})
    Path(path).write_text(json.dumps(made, indent=1, sort_keys=True, ensure_ascii=False))
    return made


def markdown(df: DataFrame) -> str:
    """A small result as a table."""
    rows = [df.columns, ["-"] * len(df.columns), *([f"{x:.4f}" if isinstance(x, float) else str(x) for x in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
