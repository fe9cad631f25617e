import pytest


@pytest.fixture(scope="session")
def vocabulary():
    from daypanel.llm.queries import vocabulary

    return vocabulary()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    long = " ".join(f"word{i} of a long text\n" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven.", "x", 1),
        (2, "one two three four five six seven.", None, 2),
        (2, "one two three four five six seven.", None, 2),
        (3, None, "x", None),
        (4, "", "y", 4),
        (None, "a text of no key at all, with words enough", "z", 5),
        (5, long, "z", 6),
        (6, long + "one more", "z", 6),
        (7, "— … 漢字 ÉÈ don't <|endoftext|> 'twas", "z", 7),
        (8, "   \n\t ", "z", 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, chunk int")
