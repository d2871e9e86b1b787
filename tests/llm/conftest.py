"""Small tables with nulls, empty and long texts, repeated rows, and extra columns with clashing names."""

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside: a table may bring them along.
CLASHING = (
    "node", "key", "root", "line", "copy", "part", "stratum", "text_key", "word", "block", "anchor", "tie", "host",
    "__times", "__key", "__first", "__map", "n_times", "line_key", "lines_gone", "copy_node", "leak_key",
)


@pytest.fixture(scope="session")
def documents(spark):
    """rows of (doc_id, text[, lang[, source]]) as a table like `documents`, with clashing columns."""

    def make(rows, clashing=True):
        filled = []
        for row in rows:
            doc_id, text, lang, source = (*row, "en", "web")[:4] if len(row) == 2 else (*row, "web")[:4]
            filled.append((doc_id, text, lang, source, None if text is None else len(text)))
        if not clashing:
            return spark.createDataFrame(filled, SCHEMA)
        extra = tuple(f"x{i}" for i in range(len(CLASHING)))
        return spark.createDataFrame(
            [row + extra for row in filled], SCHEMA + "".join(f", {name} string" for name in CLASHING)
        )

    return make


@pytest.fixture(scope="session")
def tables(sf_dir):
    """A table of the given data as tuples, by DuckDB."""

    def read(query):
        return duckdb.connect().execute(query.replace("{dir}", sf_dir)).fetchall()

    return read
