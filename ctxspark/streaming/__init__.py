"""Incremental ingestion: streams of file events and commits, and batch synchronisation that equals a full rebuild."""
