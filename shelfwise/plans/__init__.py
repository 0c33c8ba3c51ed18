"""Named queries (the registry used by ``__spark_entry__`` and ``bench.py``)."""
