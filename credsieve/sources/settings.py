"""Settings from a JSON document on any file system Spark reads."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from credsieve.config import ScanSettings, SettingsError, user_settings


def read_settings(spark: SparkSession, path: str) -> ScanSettings:
    """A user's document over the built-in settings; a missing or empty one changes nothing.

    Settings are one document: a folder may hold it as one file, several with text are an error.
    """
    try:
        texts = [r.value for r in spark.read.text(path, wholetext=True).filter("trim(value) <> ''").limit(2).collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        texts = []
    if len(texts) > 1:
        raise SettingsError(f"{path}: more than one settings document")
    try:
        data = json.loads(texts[0]) if texts else {}
    except json.JSONDecodeError as e:
        raise SettingsError(f"{path}: not a JSON document ({e})") from e
    if not isinstance(data, dict | None):
        raise SettingsError(f"{path}: not an object")
    return user_settings(data or {})
