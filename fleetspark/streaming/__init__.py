"""Structured Streaming forms of the stateful operators.

The reference polls on wall-clock time; event time and watermarks are our
addition.  Checkpoints and sinks live under ``spark.checkpoint.dir`` so a
restarted query (lost driver or executors) resumes from its offsets and
state store.
"""
