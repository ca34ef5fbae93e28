"""Structured Streaming ingest paths."""

from .ingest import (compact_latest, index_stream, latest_stream, line_stream, read_latest,
                     start_index, start_latest, tool_call_stream)

__all__ = ["compact_latest", "index_stream", "latest_stream", "line_stream", "read_latest",
           "start_index", "start_latest", "tool_call_stream"]
