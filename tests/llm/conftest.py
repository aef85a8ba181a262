import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
PROSE = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees and a farmer walks slowly home with bread and milk for supper tonight under the pale moon as bells ring far away from the quiet village square where children once played all day"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns with clashing names."""
    rows = [
        (1, PROSE, "en", "a", 1.0, 1, "k"), (1, PROSE, "en", "a", 1.0, 1, "k"), (2, None, "en", "a", None, None, None), (3, "", None, None, 0.0, 2, "k"), (None, PROSE + " end", "en", "b", 0.5, 3, "h"),
        (None, None, None, None, None, None, None), (4, LONG, "de", "b", 2.0, 4, "t"), (5, "  \n \t ", "de", "b", 2.0, 4, "t"), (6, "one two", "de", "b", 2.0, 4, "t"), (7, "one two", "fr", "c", 2.0, 4, "t"), (8, "x", "fr", "c", 2.0, 4, "t"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double, row bigint, key string")
