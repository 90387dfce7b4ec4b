"""How the query modules register their queries, and where those that write put their files."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-eventry-")
    return f"{base}/{uuid.uuid4().hex}"


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, sql: str | None = None):
        """Register a function (spark, sf_dir) under its name, with its SQL."""

        def put(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.oracles[fn.__name__] = sql
            return fn

        return put
