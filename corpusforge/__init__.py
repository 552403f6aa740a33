"""Prepare corpora of source files as model context, and carry edits back, as Spark jobs."""
