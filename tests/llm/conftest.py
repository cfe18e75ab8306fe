import pytest

LONG = "word " * 30_000 + "x" * 20_000 + " " + "1.1.1.1." * 2_000
# Columns that operators use inside, as clashing extra columns of the input.
EXTRA = {"key": "k", "content": "c", "fp": "f", "terms": "t", "base": "b", "component_id": "i", "marks": "m", "own": "o"}
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (3, "Zero one two three four five six seven eight nine ten eleven twelve thirteen; end of it"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "short text"),
    (8, LONG),
    (9, "é ñ ü ß — ünïcödé 漢字 \U0001f600 text a@b.co_x@c.de +1 (456) 555-2186 | 4111 1111 1111 1111 | 1.2.3.4.5.6.7.256"),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (None, None),
    (7, "short text"),
    (7, "another text with the same id, one two three four five six seven eight nine ten eleven twelve thirteen"),
    (-3, "same same same same same same same same same same same same same same same same same same"),
    (20, "same same same same same same same same same same same same same same same same same same same"),
]


@pytest.fixture(scope="session")
def edge_rows():
    return TEXTS


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, *EXTRA.values()) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_rows(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(rows, key=repr)
