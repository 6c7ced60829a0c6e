"""Folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from rubrica.functions.stored import checkpoint_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/rubrica-{uuid.uuid4().hex}/{name}"
