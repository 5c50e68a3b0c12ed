import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with the table's columns and one more whose name clashes with an internal one."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string")

    return make


#: Nulls, empty and blank texts, ties, repeated rows, a long text and odd characters.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (None, "one two three four five six"), (5, "ONE two three four five six"),
    (6, "a b"), (7, "A  b\n"), (8, "á é İ Σας ½ 中文 \U0001f600 don't <|endoftext|> <|x"), (9, "word " * 30000), (4, "another text under the same id"), (10, "x" * 5000), (11, "\x1c\x85　 \x00"),
]
