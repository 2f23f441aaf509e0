"""The shared folder, as the rest of the library uses it, and batches bounded by bytes."""

from pyspark.sql import SparkSession

from ..sources import shared
from ..sources.shared import shared_dir
from .memory import bound_batches

__all__ = ["Scratch", "shared_dir"]


class Scratch(shared.Scratch):
    """A folder of a job of this subpackage, whose tasks hold texts."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        super().__init__(spark, label)
