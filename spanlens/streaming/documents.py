"""Analysis of documents as they arrive.

Row-wise findings (cleaning, redaction, terms, periods) are plain projections and
run on a stream unchanged.  Findings with windows over lines need whole
documents; a micro-batch holds whole documents, so they run batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from spanlens.operators import buzzwords, pii
from spanlens.operators.periods import period_rows
from spanlens.plans.engine import Analysis
from spanlens.sources.documents import load_text


def stream_redacted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, pii)`` of a stream of ``(doc_id, text)``."""
    return pii.redact_documents(load_text(docs.select("doc_id", "text")))


def stream_periods(docs: DataFrame) -> DataFrame:
    """Periods anywhere in each redacted document of a stream."""
    return period_rows(stream_redacted(docs))


def stream_buzzwords(docs: DataFrame) -> DataFrame:
    return buzzwords.buzzwords(stream_redacted(docs))


def analyze_stream(docs: DataFrame, now_ym: int, write: Callable[[str, DataFrame, int], None], checkpoint: str, names: list[str] | None = None) -> StreamingQuery:
    """Start a query that calls ``write(name, relation, batch_id)`` for each finding of each micro-batch.

    ``write`` must be idempotent by batch id, since a batch that failed midway
    runs again.  Relations the findings share are computed once a batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        found = Analysis(batch, now_ym, keep=True)
        try:
            for name, relation in found.relations().items():
                if names is None or name in names:
                    write(name, relation, batch_id)
        finally:
            found.release()

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
