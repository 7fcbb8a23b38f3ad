import pytest

#: Null and blank texts, ties, repeated rows, a null id and source, and columns that clash with results'.
ROWS = [
    (1, "The cat sat on the mat and looked at the moon all night long", "en", "b"),
    (2, "The cat sat on the mat and looked at the moon all night long", "en", "b"),
    (2, "The cat sat on the mat and looked at the moon all night long", "en", "b"),
    (3, "", "en", "a"),
    (4, None, None, None),
    (5, "   \n\t ", "fr", "a"),
    (6, "Le chat noir dort sur le lit ▁ étrange <0x0A> </s>  deux  espaces \r\n fin", "fr", None),
    (7, "12345 67890 !!!", None, "c"),
    (None, "A row without an id", "en", "c"),
    (8, "word " * 40_000, "en", "a"),
    (9, "Ünïcödé ŝtrîng ﬁ ①  🙂 𝒳 日本語 テスト", "de", "c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, score string, shard string, size string, fingerprint string, copies string, item_id string, stats string, n_tokens string, media string"
    return spark.createDataFrame([(*r, *["x"] * 9) for r in ROWS], schema)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
