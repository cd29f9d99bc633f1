import pytest

CHUNKS = "vec_id long, source_path string, file_extension string, source_type string, chunk_text string, start_char int, parent_section string, kind string, n long, model string, word string, rank int"


@pytest.fixture(scope="session")
def chunks(spark):
    """Chunks from (vec_id, path, text, start) tuples, with extra columns whose names clash with inner ones."""

    def make(rows, source_type="document"):
        full = [(v, p, None, source_type, t, s, None, "x", 1, "m", "w", 9) for v, p, t, s in rows]
        return spark.createDataFrame(full, CHUNKS)

    return make
