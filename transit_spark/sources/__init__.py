"""Readers, decoders, ingest jobs and sinks."""
