import pytest

WORDS = ["Alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu", "xi", "pi", "rho"]


def sentence(start: int, length: int) -> str:
    """Invented prose without repeated stretches."""
    return " ".join(f"{WORDS[(start * 7 + i * i) % len(WORDS)]}{(start * 31 + i * 17) % 97}" for i in range(length))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    base = sentence(1, 60)
    near = base.rsplit(" ", 1)[0] + " changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base, "de", None), (3, base, "de", None), (4, near, None, "b"),
        (5, None, "en", "b"), (6, "", "en", "b"), (7, "  \n\t ", "fr", "b"), (None, base, "en", "a"), (None, None, None, None),
        (8, "word", "en", "a"), (9, "Word", "en", "a"), (10, sentence(2, 20_000), "en", "a"), (11, "x" * 50_000, "en", "a"),
        (12, "123 !!! ??? 456", "en", "a"), (13, sentence(3, 40), "en", "a"), (3, sentence(4, 40), "en", "a"),
    ]
    extra = [(*r, i, f"k{i}", 0.5, 7) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, row long, KEY string, score double, Run int"
    return spark.createDataFrame(extra, schema).repartition(3, "row")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
