"""Readers and writers: file trees, text artefacts and versioned tables."""
