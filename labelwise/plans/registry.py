"""All registered queries by name: ``(callable(spark, sf_dir), oracle SQL or None)``."""

from labelwise.plans import extraction, live, reading, storage, workflow

QUERIES = {**workflow.QUERIES, **reading.QUERIES, **extraction.QUERIES, **live.QUERIES, **storage.QUERIES}
