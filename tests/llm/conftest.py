import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns, named like what the operators use themselves.
CLASHING = ["score", "n_words", "component_id", "rep", "copies", "size", "target", "pos", "block", "_copies", "_language", "_toxic", "_id", "h", "label_id"]


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"paragraph{k} of a very long text." for k in range(60_000))
    same = "the same words stand here again and again for a while, and nothing else does."
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "12345 67.", "de", "b"), (5, same, "en", "a"), (5, same, "en", "a"), (6, same, None, None),
        (None, "a row without an id but with words", "en", "a"), (7, long, "en", "b"), (8, "one", "en", "b"), (9, "Ein kurzer Satz über Äpfel 😀 und é.", "de", "c"), (10, "\x00 odd \x85 signs here", "en", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, len(r[1] or ""), *[None] * len(CLASHING)) for r in rows], schema)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
