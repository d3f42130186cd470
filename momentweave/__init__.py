"""Spark jobs that mine highlights from a corpus of timed transcripts."""
