"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: By application, the folder chosen where none is set.
_chosen: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one spark.checkpoint.dir names.

    Where the setting is absent in local mode (tests in one process) a temporary folder is made, which goes
    when Python ends; elsewhere executors could not see it, so this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _chosen:
        _chosen[app] = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _chosen[app], ignore_errors=True)
    return _chosen[app]


def new_path(spark: SparkSession, what: str) -> str:
    """A path nobody else uses, in the shared folder and below one folder for the application."""
    return f"{shared_dir(spark)}/lodestrata/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
