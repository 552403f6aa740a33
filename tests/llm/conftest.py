import pytest

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, or from (doc_id, text) or (doc_id, text, source) rows."""
    def make(*rows):
        full = [(i, r) if isinstance(r, str) or r is None else r for i, r in enumerate(rows)]
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in full], TABLE)
    return make


@pytest.fixture(scope="session")
def clashing(documents):
    """Ordinary rows with extra columns whose names operators use inside."""
    def make(*rows):
        df = documents(*rows)
        for name in ("row", "_row", "_text", "runs", "items", "n", "class", "id", "h", "rate", "label", "size", "_copies"):
            df = df.selectExpr("*", f"concat('extra ', doc_id) as `{name}`")
        return df
    return make


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
