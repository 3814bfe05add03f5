"""Reading and writing: ledgers, glossaries, packs, dictionaries, safe exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bitloom.functions import text as T

LEDGER = (
    "event string, taskId string, timestamp double, elapsedMs double, provider string, model string, callId string, purpose string, operationId string, "
    "paragraphIds array<string>, parentCallId string, retryCause string, succeeded boolean, cancelled boolean, latencyMs double, statusCode int, complete boolean, "
    "input bigint, output bigint, cachedInput bigint, reasoning bigint, status string, accepted int, rejected int"
)
PACK = "schemaVersion int, id string, version string, sourceLang string, targetLang string, sources array<struct<name:string,url:string,license:string,licenseUrl:string>>, entries array<struct<source:string,target:string,tgt_lng:string>>"
NESTED = "map<string,struct<readings:array<string>,defs:array<struct<def_cn:string,def_en:string,pos_en:string,pos_cn:string,ai:boolean,ext:array<struct<ext_en:string,ext_cn:string>>>>>>"


def read_ledger(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Line-by-line JSON ledgers as one table; blank and damaged lines have no event and are left out."""
    reader = (spark.readStream if streaming else spark.read).schema(LEDGER)
    return reader.json(path).where("event is not null")


def read_glossary_csv(spark: SparkSession, path: str, target_lang: str | None = None) -> DataFrame:
    """(source, target, tgt_lng) of a CSV file whose header holds source and target, tgt_lng if it likes, and nothing else; quoted fields and line breaks in them are kept, rows of another language are not."""
    raw = spark.read.option("multiLine", True).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    if len(set(names)) != len(names) or not {"source", "target"} <= set(names) or set(names) - {"source", "target", "tgt_lng"}:
        raise ValueError(f"a glossary has columns source, target and maybe tgt_lng, not {names}")
    df = raw.toDF(*names)
    if "tgt_lng" not in names:
        df = df.withColumn("tgt_lng", F.lit(None).cast("string"))
    df = df.where("trim(source) <> '' and trim(target) <> ''").select(F.trim("source").alias("source"), F.trim("target").alias("target"), T.lang_key(F.coalesce("tgt_lng", F.lit(""))).alias("tgt_lng"))
    return df if target_lang is None else df.where((F.col("tgt_lng") == "") | (F.col("tgt_lng") == T.lang_key(F.lit(target_lang))))


def write_glossary_csv(df: DataFrame, path: str) -> None:
    """The three columns of a glossary, a null language as an empty field."""
    df.select("source", "target", F.coalesce("tgt_lng", F.lit("")).alias("tgt_lng")).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_glossary_pack(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """(id, version, source, target, tgt_lng) of pack files whose size, digest, number of entries and language are the catalog's (id, version, sha256, size_bytes, entry_count, target_lang)."""
    files = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "UTF-8"), PACK).alias("p"))
    sure = files.join(catalog, "sha256").where((F.col("length") == F.col("size_bytes")) & (F.col("p.id") == F.col("id")) & (F.col("p.version") == F.col("version")) & (F.size("p.entries") == F.col("entry_count")) & (F.col("p.targetLang") == F.col("target_lang")))
    return sure.select("id", "version", F.explode("p.entries").alias("e")).select("id", "version", "e.*")


def validate_pack_catalog(df: DataFrame) -> DataFrame:
    """(id, version, violations) of a catalog (id, version, sha256, size_bytes, entry_count, attribution)."""
    from pyspark.sql import Window

    twice = F.count("*").over(Window.partitionBy("id", "version")) > 1
    no = lambda c: ~F.coalesce(c, F.lit(False))
    codes = F.array_compact(
        F.array(
            F.when(no(F.col("id").rlike("^[a-z0-9][a-z0-9-]{0,63}$")), "bad_id"), F.when(no(F.col("version").rlike(r"^\d+(\.\d+){0,3}$")), "bad_version"), F.when(twice, "duplicate_id"),
            F.when(no(F.col("sha256").rlike("^[0-9a-f]{64}$")), "bad_digest"), F.when(no(F.col("size_bytes").between(1, 64 * 1024 * 1024)), "bad_size"), F.when(no(F.col("entry_count") > 0), "bad_count"), F.when(no(F.trim("attribution") != ""), "no_attribution"),
        )
    )
    return df.select("id", "version", codes.alias("violations"))


def read_nested_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, reading, senses, is_ai, skipped): senses with a translation in Han, with the first two examples that have both sides; words without such a sense are counted in skipped rows with null senses."""
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", NESTED)).alias("word", "e"))
    both = lambda x: (F.trim(x["ext_en"]) != "") & (F.trim(x["ext_cn"]) != "")
    kept = F.filter("e.defs", lambda d: F.coalesce(d["def_cn"].rlike("[㐀-鿿]"), F.lit(False)))
    senses = F.transform(
        kept,
        lambda d: F.struct(
            F.trim(d["def_cn"]).alias("chinese"), F.trim(d["def_en"]).alias("english"), F.coalesce(d["pos_en"], d["pos_cn"]).alias("pos"),
            F.slice(F.transform(F.filter(F.coalesce(d["ext"], F.array().cast("array<struct<ext_en:string,ext_cn:string>>")), both), lambda x: F.struct(x["ext_en"].alias("source"), x["ext_cn"].alias("target"))), 1, 2).alias("examples"),
        ),
    )
    reading = F.filter("e.readings", lambda r: F.trim(r) != "")
    return raw.select("word", F.get(reading, 0).alias("reading"), F.when(F.size(kept) > 0, senses).alias("senses"), F.coalesce(F.exists("e.defs", lambda d: F.coalesce(d["ai"], F.lit(False))), F.lit(False)).alias("is_ai"), (F.coalesce(F.size(kept), F.lit(0)) < 1).alias("skipped"))


def safe_csv(df: DataFrame) -> DataFrame:
    """df with string columns that no spreadsheet takes for a formula."""
    return df.select(*(T.csv_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema))


def write_safe_csv(df: DataFrame, path: str) -> None:
    safe_csv(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
