import pytest

from wayfold.llm import common

#: Null and odd rows that every operator must take: (doc_id, text, n_tokens as a clashing name)
ODD = [(1, None, 1), (2, "", 2), (3, "   \n\t ", 3), (4, "one", 4), (4, "one", 4), (None, "no id here at all", 5), (5, "ÉCOLE école <|endoftext|> don't 漢字 é ½ a" + "x" * 300, 6), (6, "word " * 4000, 7), (7, "y" * 9000, 8)]


@pytest.fixture(scope="session")
def odd(spark):
    common.ship(spark)
    return spark.createDataFrame(ODD, "doc_id long, text string, n_tokens int")


@pytest.fixture(scope="session")
def documents(spark):
    common.ship(spark)
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
