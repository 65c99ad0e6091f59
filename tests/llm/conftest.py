import pytest

from draftspark.llm.registry import reachable

SF = "/root/testdata/sf0.001"
#: The columns that clash with names the operators use inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, shard string, block string"


@pytest.fixture(scope="session")
def llm(spark):
    reachable(spark)
    return spark


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(llm):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns."""
    line = "The same long line of more than forty characters, everywhere."
    long = " ".join(f"word{i} of a very long text" for i in range(20_000))
    rows = [(1, "hello world, this is a text\n" + line), (2, None), (3, ""), (4, long), (5, line), (5, line), (6, line.upper() + "\nother"), (None, line),
            (7, line + "\n\n" + line), (None, None), (8, "   \n\t "), (9, long), (10, "é" * 60), (11, line), (12, "日本語 \U0001F389 x"), (13, "a\x00b\r\n")]
    return llm.createDataFrame([(i, t, "en" if t else None, None, None, "r", "s", "h", "b") for i, t in rows], EXTRA)


@pytest.fixture
def empty(llm):
    return llm.createDataFrame([], EXTRA)
