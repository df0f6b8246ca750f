from pyspark.sql import functions as F

import pyarrow as pa

from lectern.llm.common import BATCH_BYTES, map_texts


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """2,000 texts of 20 KB are 40 MB, which Spark's own bounds leave in one batch."""
    docs = spark.range(2000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("text"))

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        # a slice's buffers are those of the batch that came
        return pa.RecordBatch.from_pydict({"n": [batch.num_rows], "held": [sum(b.size for b in batch.column("text").buffers() if b)]})

    rows = map_texts(docs, "text", "n long, held long", held).collect()
    assert sum(r.n for r in rows) == 2000 and max(r.held for r in rows) < BATCH_BYTES + 100_000
