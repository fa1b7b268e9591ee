"""Folders for what a plan writes and reads again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession

_OWN: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, in one for each application that goes when Python exits.

    Only a local master may do without the setting; elsewhere a folder of one machine would lose what the others write.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^-]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        base = f"file://{tempfile.gettempdir()}"
    own = f"{base.rstrip('/')}/rankweave-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(removed, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch() named; what can't be deleted stays."""
    with suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
