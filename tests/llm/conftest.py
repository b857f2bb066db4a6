import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table with its rows, read once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, {r["doc_id"]: r["text"] for r in docs.collect()}


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, one endless word."""
    text = " ".join(f"word{i % 37} other{i % 11} thing{i}" for i in range(90))
    return [
        (1, text, "en", "a", len(text)), (2, text, "en", "a", len(text)), (2, text, "en", "a", len(text)),
        (3, None, None, None, None), (None, text + " tail", "fr", "b", 10), (None, None, None, None, None),
        (4, "", "en", "a", 0), (5, " \t\n\x0b\x0c\r ", "de", "a", 7), (6, "x", "en", None, 1), (7, "12 34 !? 5", "es", "b", 10),
        (8, "é" * 3000, "fr", "b", 3000), (9, "ab " * 60000, "en", "a", 180000), (10, "q" * 70000, "en", "a", 70000),
        (11, "<|endoftext|> İstanbul ΑΣ é  x y \U0001f600", "de", "c", 40), (12, "one two three", "en", "c", 13),
        (13, "ONE two\tthree", "en", "c", 13),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like the operators' own."""
    out = odd
    for name in ("component_id", "score", "n", "found", "spans", "id", "d", "t", "th", "v", "h", "start", "stop", "kept",
                 "slot", "shard", "at", "label", "fold", "gone_id", "item_id", "_dealt", "piece", "digest", "keys"):
        out = out.selectExpr("*", f"'x' as `{name}`")
    return out


def by_id(rows, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in rows), key=repr)
