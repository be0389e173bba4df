import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, t1 string, n_words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long, repeated and special texts, with columns whose names the operators use themselves."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
    texts = [None, "", " \n\t ", "one", "É, naïve! <|endoftext|> ’s 日本語  x", base * 40, base * 40, "x" * 5000, "idiot you MORON !!!", "tail " + base * 21 + "end"]
    rows = [(i, t, "en" if i % 3 else None, None if i == 2 else f"s{i % 3}", None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "null id " + base, None, None, 1, None, None, None), (77, "\U0001f600" * 500, "fr", "s1", 500, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
