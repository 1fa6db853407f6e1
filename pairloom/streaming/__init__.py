"""Incremental work: resumable batches and streams of new files."""
