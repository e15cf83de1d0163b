"""Readers and writers: review files, landed feed pages, results, checkpoints."""
