"""The document features on a stream: they are stateless per row, so the batch
projection runs unchanged under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexora.operators.features import document_features


def stream_features(docs: DataFrame, keys: list[str], body: str = "text", **kw) -> DataFrame:
    if not docs.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return document_features(docs, keys, body, **kw)
