from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash."""
    from pyspark.sql import functions as F

    def build(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("score", "n", "key", "c", "row", "a", "b", "keep", "digest", "pass", "size"):
                df = df.withColumn(name, F.lit(7))
        return df

    return build
