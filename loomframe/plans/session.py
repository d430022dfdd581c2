"""The session, and its configuration in layers: defaults, an ini file, run-time settings."""

from __future__ import annotations

import configparser
import os

from pyspark.sql import SparkSession

VERSION = "0.1.0"
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def settings(path: str | None = None, given: dict | None = None) -> dict[str, str]:
    """The layers merged; an ini file's section [spark] has keys with or without the prefix ``spark.``."""
    merged = dict(DEFAULTS)
    if path and os.path.exists(path):
        ini = configparser.ConfigParser()
        ini.optionxform = str
        ini.read(path)
        for key, value in ini["spark"].items() if ini.has_section("spark") else ():
            merged[key if key.startswith("spark.") else f"spark.{key}"] = value
    merged.update({str(k): str(v) for k, v in (given or {}).items()})
    return merged


def session(given: dict | None = None, path: str | None = None) -> SparkSession:
    """The running session, or a new one. Nothing of a running session is changed unless ``given`` says so."""
    running = SparkSession.getActiveSession()
    if running is not None:
        for key, value in (given or {}).items():
            running.conf.set(key, value)
        return running
    return SparkSession.builder.config(map=settings(path, given)).getOrCreate()


def spark_context():
    return session().sparkContext


def config() -> dict[str, str]:
    """All settings of the running session."""
    return dict(session().conf.getAll)


def jobs() -> dict[int, str]:
    """Active jobs and the names of their groups; to be called from another thread than the one that runs them."""
    tracker = spark_context().statusTracker()
    return {j: str(tracker.getJobInfo(j).status) for j in tracker.getActiveJobsIds()}


def ship_code(path: str) -> None:
    """Send a Python file, zip or egg to the executors."""
    spark_context().addPyFile(path)


def version() -> str:
    return VERSION
