import pytest

LONG = "word " * 30_000
#: Null and empty texts, ties, repeated rows and ids, null ids and sources, very long texts; the extra columns clash with names used inside.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a"), (2, "the  quick brown fox\njumps over the lazy dog " * 3, "en", "b"),
    (3, None, None, None), (4, "", "en", "a"), (5, " \n\t ", "fr", None), (5, "zwei Zeilen für id fünf", "de", "a"), (6, "zwei Zeilen für id fünf", "de", "c"),
    (6, "zwei Zeilen für id fünf", "de", "c"), (None, "zwei Zeilen für id fünf", "de", "b"), (None, None, "de", "b"), (7, LONG, "en", "c"), (8, LONG + "x", "en", "c"),
    (9, "x" * 100_000, "en", "c"), (10, "ünïcödé 😀 " * 20, "fr", "b"), (11, "...!?123", "en", "b"),
]
#: Columns named as the operators name theirs inside.
CLASHES = {
    "name": "clash", "level": "clash", "fp": 1, "size": 2, "_row": 3, "copies": 4, "_text": "own", "_lang": "own", "_key": 5, "_both": 6, "_copy": 7, "_score": 8, "_rejected": 9, "key": 10,
    "rid": 11, "h": 12, "block": 13, "first": 14, "_input0": 15, "x.y": 16, "a b": 17, "c0": 18, "q`q": 19,
}


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, 0, *CLASHES.values()) for r in ROWS]
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    extra = ", ".join(f"{quoted(name)} {'string' if isinstance(value, str) else 'long'}" for name, value in CLASHES.items())
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
