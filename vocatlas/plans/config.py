"""Configuration and its hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def load_config(path: str) -> dict:
    """A YAML file's values, or a JSON file's where no YAML parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ModuleNotFoundError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def config_hash(content: bytes, length: int = 12) -> str:
    """The first digits of the sha256 of a file's bytes."""
    return hashlib.sha256(content).hexdigest()[:length]


def file_hash(spark: SparkSession, path: str, length: int = 12) -> str:
    """``config_hash`` of a file in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, length).alias("h")).first().h
