"""Structured Streaming: cleaning on ingest, stateful monotonicity, delivery and sinks."""
