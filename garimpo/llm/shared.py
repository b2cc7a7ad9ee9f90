"""Values sent once to every executor."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    """A broadcast that executors can open without a copy of this package.

    A plain broadcast pickles objects of the package's classes by reference. Here
    the value is pickled together with its classes, and every worker process
    unpickles it once, however many tasks it runs."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.box = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        if not hasattr(self.box, "opened"):
            self.box.opened = cloudpickle.loads(self.box.value)
        return self.box.opened

    def drop(self) -> None:
        """Free the executors' and the driver's copies; no job may need it any more."""
        self.box.destroy()
