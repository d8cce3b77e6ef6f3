"""Where intermediate tables go: the shared folder named by the session."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and stage tables, readable by every executor.

    It is read from ``spark.checkpoint.dir``; a folder named there is taken to be shared, also
    one without a scheme, such as a mounted one. Only a local session without that
    setting gets a temporary folder; a cluster without it is an error, since a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    local = re.fullmatch(r"local(\[.*\])?", context.master) is not None
    if not folder:
        if not local:
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder")
        folder = tempfile.mkdtemp(prefix="fieldsurvey-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten there."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
