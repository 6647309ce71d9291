import sys
from pathlib import Path

import pytest

#: Names that operators use inside; tables may have columns of the same names.
CLASHES = ("key", "row", "rank", "n", "size", "h", "words", "score", "spans", "token", "place", "component_id", "rules", "text_a")


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text) rows with the other columns of documents, and columns that clash."""

    def make(rows, lang="en", source="src0"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, r[3] if len(r) > 3 else source, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for name in CLASHES:
            df = df.selectExpr("*", f"'{name}' AS `{name}`")
        return df

    return make
