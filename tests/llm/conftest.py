import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size string, node int, dd_row int"


def _odd():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of them until night comes down at last"
    texts = [None, "", " \t\n", base, base, base + " x", "one two", "a\x1cb\xa0c d", "İǅ ΣΣ é <|endoftext|> 12,34.", "w" * 5000 + " " + "v, " * 9000, "!! $$ ## | <x>", "l\nl\n\nl\n \n \nm"]
    rows = [(k, t, ["en", None, "fr"][k % 3], [None, "a", "", "b"][k % 4], k, k, "z", k, k) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (99, base.upper(), "en", "a", 1, 1, "q", 1, 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(_odd(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int")
