import pytest

#: Nulls, empty texts, ties, repeated rows and odd characters.
TEXTS = [
    (1, "the cat sat on the mat and the dog sat on the log near the cat and the dog again today", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \n\t ", "en", "b"),
    (5, "der Hund lief über die Straße und die Katze schlief im Haus an der Straße, schön", "de", "b"),
    (6, "one two three four five six seven eight nine ten\n" * 12, "en", "a"),
    (7, "ÉTÉ naïve Çà 日本語テキスト ½ x² ٣ 😀 don't I'LL\x1c\x1d x\x85y z\xa0w", "fr", "b"),
    (8, "a" * 3000 + " " + "xyzq" * 400, "en", "c"),
    (9, "# * $ % & | < > !!! ### $$$ %%%", "en", "c"),
    (6, "one two three four five six seven eight nine ten\n" * 12, "en", "a"),
    (None, "a row without an id has words all the same", "en", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with all of these, and extra columns that clash with names that operators use."""
    rows = [(*r, len(r[1] or ""), "x", 1) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_words int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
