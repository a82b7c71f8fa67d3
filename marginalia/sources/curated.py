"""Curated records: text files with a block of metadata before the prose, the project registry, fragments and attestations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..plans.review import migrate
from .files import read_json

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"


def metadata_of(block: str) -> dict:
    """The mapping that a metadata block gives, as YAML; anything but a mapping counts as none."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("curated records need PyYAML for their metadata") from error
    found = yaml.safe_load(block)
    return found if isinstance(found, dict) else {}


def _json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(meta=[json.dumps(metadata_of(m), ensure_ascii=False, default=str) for m in pdf["meta"]])


def read_curated(spark: SparkSession, root: str) -> DataFrame:
    """Node records below a folder, with file, raw and body. Files without a metadata block are errors; missing lists are empty."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx}").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    ok = F.when(F.col("raw").rlike(FRONT), F.regexp_extract("raw", FRONT, 1)).otherwise(F.raise_error(F.concat(F.lit("no metadata block in "), "file")))
    parts = files.select("file", "raw", F.regexp_extract("raw", FRONT, 2).alias("body"), ok.alias("meta"))
    parsed = parts.mapInPandas(_json, "file string, raw string, body string, meta string")
    schema = T.StructType([*S.NODE.fields, *S.LEGACY.fields])
    return with_defaults(migrate(parsed.withColumn("n", F.from_json("meta", schema)).select("file", "raw", "body", "n.*")))


def with_defaults(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in S.NODE.fields if isinstance(f.dataType, T.ArrayType)})


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """key, title, short, description, anchor, direction of the registry, a JSON map."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), S.PROJECT))).alias("key", "p")).select("key", "p.*")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.FRAGMENT)


def read_attestations(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.ATTESTATION)


def serialize(nodes: DataFrame) -> DataFrame:
    """file, text: the record as it is written, metadata as JSON (which is YAML too), the prose untouched."""
    meta = F.to_json(F.struct(*(f.name for f in S.NODE.fields)))
    return nodes.select("file", F.concat(F.lit("---\n"), meta, F.lit("\n---\n"), F.coalesce("body", F.lit(""))).alias("text"))
