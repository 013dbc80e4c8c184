import hashlib

import pytest

SF_DIR = "/root/testdata/sf0.001"

#: Nulls in every column, empty and blank texts, one long text, repeated rows, ties, texts that share a passage.
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 3
ROWS = [
    (1, PASSAGE + "first ending of the text", "en", "a", 10), (2, PASSAGE + "first ending of the text", "en", "a", 10),
    (2, PASSAGE + "first ending of the text", "en", "a", 10), (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "de", "b", 3),
    (None, "a row without an id but with some words in it", "fr", "b", 5), (6, "héllo wörld ñandú 🙂 <|endoftext|> \\ end", "es", None, 7),
    (7, "word " * 30_000, "en", "c", 150_000), (8, "x", "de", "c", 1), (9, "one line\none line\nanother line\n" * 20, "en", "b", 9),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark, tmp_path_factory):
    """The rows above as a table, with extra columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("hard") / "documents.parquet")
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "n_chars AS id", "lang AS key", "n_chars AS n", "source AS copy", "n_chars AS size", "lang AS bucket")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
