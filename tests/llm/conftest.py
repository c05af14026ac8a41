import pytest

#: id, text, lang and clashing extra columns: nulls, blanks, repeats, a very long text.
ROWS = [
    (1, "the cat sat on the mat and the dog sat on the rug by the door", "en", "a", "x", 1.0),
    (2, "The cat sat on the mat and the dog sat on the rug by the door", "en", "a", "x", 1.0),
    (3, None, None, None, None, None),
    (4, "", "en", "b", "y", 0.0),
    (5, " \t\n ", "fr", "b", "y", 0.0),
    (6, "le chat est sur la table et le chien est sous la chaise dans la maison", "fr", "b", "z", 2.0),
    (6, "le chat est sur la table et le chien est sous la chaise dans la maison", "fr", "b", "z", 2.0),
    (7, "word " * 20000 + "end", "en", "c", "q", 3.0),
    (8, "x" * 30000, None, "c", "q", 3.0),
    (None, "a text without an id that is otherwise quite ordinary and short", "en", "c", "q", 3.0),
    (9, "1234 !!! 5678 ... ???", "en", "d", "q", 3.0),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, score string, component_id double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
