import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd_items(spark):
    """Nulls, empty, blank and long texts, repeated rows, and a column that operators use inside."""
    rows = [(1, "the glaze breaks over texture " * 30, 0), (1, "the glaze breaks over texture " * 30, 0), (2, None, 1), (3, "", 1), (4, " \t ", 2),
            (None, "the glaze breaks over texture " * 30, 3), (5, "a" * 20_000, 4), (6, "one", 5), (7, "iron red over black " * 3000, 6)]
    return spark.createDataFrame(rows, "item_id long, description string, score int")
