import pytest

IDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text) or (doc_id, text, lang, source) rows, with columns that might clash."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", 0) for r in rows]
        df = spark.createDataFrame(full, IDS)
        for name in ("row", "_row", "h", "node", "n", "label", "doc", "blob", "size", "place", "_key", "rank", "id"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, quality int, toxic int")

    return make
