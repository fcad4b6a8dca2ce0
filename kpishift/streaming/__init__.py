"""Incremental (Structured Streaming) form of the report."""

from .incremental import file_stream, published, stream_report, streaming_periods

__all__ = ["file_stream", "published", "stream_report", "streaming_periods"]
