"""Incremental extraction: new filings are read as a stream and each micro-batch goes through the batch operators.

Extraction keeps no state between documents, so a batch is complete by itself; de-duplication across deals runs over the
written facts. A batch writes its own folder, so a replayed batch overwrites only itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import extraction as X
from ..sources.html import html_to_document


def extract(filings: DataFrame) -> DataFrame:
    """Judged candidates (facts where reason is null) of filings (accession, html)."""
    docs = html_to_document(filings.where("accession IS NOT NULL"), "html", "accession")
    return X.extract(docs, "accession", lines="lines")


def ingest(spark: SparkSession, source: str, schema: StructType | str, out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Reads all Parquet filings that ``source`` has gained since the last run and writes their facts below ``out``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
