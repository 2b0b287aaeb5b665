import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, id long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, names that clash with the operators' own."""
    long = " ".join(f"w{i % 997} and{i}" for i in range(40_000))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [None, "", " \n\t ", "A", "a b c d e", long, long, passage, passage + " Z", "Ünï çödé " * 30, passage.upper(), "x" * 300, "line one\nline two\n\nline one", "\x00 odd \x0b\x85 bytes"]
    rows = [(i, t, "en", "src0", len(t or ""), 0.5, 7, -i) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[0], (None, "no id at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
