import pytest

from sifter.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, fp string, term string"


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls, empties, very long texts, ties, repeats and clashing column names."""
    long = "The quick brown fox number %d jumps over the lazy dog again. "
    rows = [(1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "ONE"), (6, "".join(long % i for i in range(4000))), (7, "one"), (7, "one"),
            (None, "one"), (None, None), (8, "Écrire à jean.dupont@mail.example.com le 4111 1111 1111 1111."), (9, "🙂 ß ǅ İstanbul <|endoftext|> 'tis")]
    return llm.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None, "x", "y", "z") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOCS)
