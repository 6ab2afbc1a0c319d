"""The append-only observation log as streams.

Event times are TIMESTAMP here because watermarks need them; the session zone
is UTC, so they equal the naive UTC times of the batch tables. Checkpoints and
sinks live in the shared folder named by ``spark.checkpoint.dir``.
"""
