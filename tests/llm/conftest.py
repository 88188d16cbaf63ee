import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""
    def make(*rows, source="s1", lang="en"):
        names = "doc_id long, text string, lang string, source string, n_chars long, id int, fp int, key int, _id int, _key int, _spans int, text_key int, host int, h1 int, kind int"
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), *range(10)) for i, t in rows], names)
    return make
