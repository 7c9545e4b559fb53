"""Landing of a paginated source: pages are fetched in tasks, kept as JSON lines, and read back without repeats."""
import json
import math
import sys
import time
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Worker code travels with the job, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def land(spark: SparkSession, fetch: Callable[[int], dict], path: str, force: bool = False, pages_a_task: int = 20, pause: float = 0.12) -> DataFrame:
    """page, place and value (JSON text) of all elements of a source, landed at ``path`` and read from there.

    fetch(page) gives {'total': n, 'elements': [...]} and runs in the tasks, so it must travel with the job. The first page
    tells how many there are; each task fetches ``pages_a_task`` of the others, one after another with a pause between, and
    a lost task fetches its own again. Pages that are there already are not fetched, unless ``force`` says so."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not force and hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema("page int, place int, value string").json(path)
    first = fetch(1)
    size = len(first["elements"])
    last = math.ceil(first["total"] / size) if size else 1

    def run(batches):
        for pdf in batches:
            for page in pdf["page"]:
                found = first if page == 1 else fetch(int(page))
                if page > 1:
                    time.sleep(pause)
                rows = [(page, i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(found["elements"])]
                yield pd.DataFrame(rows, columns=["page", "place", "value"])
    numbers = spark.range(1, last + 1, 1, max(1, -(-last // pages_a_task))).select(F.col("id").cast("int").alias("page"))
    numbers.mapInPandas(run, "page int, place int, value string").write.mode("overwrite").json(path)
    return spark.read.schema("page int, place int, value string").json(path)


def elements(landed: DataFrame, schema: str, key: str = "id") -> DataFrame:
    """The landed elements as columns of a schema, one for each key: the one of the first page and place that has it."""
    rows = landed.select(F.struct("page", "place").alias("__at"), F.from_json("value", schema).alias("e")).select("__at", "e.*")
    rest = [c for c in rows.columns if c not in ("__at", key)]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), "__at").alias("e"))
    return best.select(key, *(F.col(f"e.{c}").alias(c) for c in rest))
