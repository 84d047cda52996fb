"""Texts go to Python workers in small batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from hitlake.llm import common, minhash

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_small(spark):
    before = spark.conf.get(NAME)
    docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat("id", F.lit(" word ")), 8000).alias("text"))
    try:
        minhash.near_duplicates(docs)  # about 30 MB in one task
        sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
        assert len(sizes) > 5 and max(x[0] for x in sizes) < 2 * common.BATCH
        spark.conf.set(NAME, "1000000")
        common.small_batches(spark)
        assert spark.conf.get(NAME) == "1000000"
    finally:
        spark.conf.set(NAME, before)
