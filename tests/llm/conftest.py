import pytest

COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
           "score double, words array<string>, _row bigint, kept boolean, spans string, seed bigint, c int, c_1 int, url string")
EXTRA = (0.5, ["x"], 7, False, "s", 1, 2, 3, None)

LONG = "lorem ipsum dolor sit amet " * 4000
PROSE = ("the river runs past the old mill and the people of the town walk along its banks every evening "
         "to look at the boats that come back from the sea with fish and salt and news of other places")


def messy_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing extra columns."""
    base = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE.upper(), "en", "a"), (3, None, "en", "b"), (4, "", None, None),
        (5, " \n\t ", "de", "b"), (6, "one two three", "en", None), (7, "one two three", None, "a"), (None, PROSE, "en", "a"),
        (None, None, None, None), (8, LONG, "en", "c"), (9, "é ü 日本 \x0b x", "fr", "c"), (10, "12345 !!! 678", "en", "c"),
        (11, "la rivière passe près du moulin et les gens de la ville marchent le long de ses rives", "fr", "a"),
        (12, "der Fluss zieht an der Mühle vorbei und die Leute der Stadt gehen am Ufer entlang", "de", "a"),
    ]
    return [(i, t, g, s, None if t is None else len(t), *EXTRA) for i, t, g, s in base]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest driver table of documents, all rows."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(autouse=True, scope="session")
def _clean():
    yield
    from logweave.llm.shared import drop_written
    drop_written()
