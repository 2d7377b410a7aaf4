"""Streaming extensions: incremental disagreement and windowed accuracy."""

from itemscope.streaming.incremental import (  # noqa: F401
    accuracy_stream,
    changelog_sink,
    latest,
    pds_from_state,
    pds_stream,
)
