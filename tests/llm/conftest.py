import random

import pytest


def words(r, n, low=1, high=9):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(low, high))) for _ in range(n))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, odd white space, and extra columns whose names
    operators use for results of their own."""
    r = random.Random(5)
    base, long = words(r, 120), words(r, 30_000)
    texts = [base, base, base + " end", base.upper(), None, "", " ", " \n\t ", "a", "A b", "a  b \n\n c\td　e\x1cf", long, long + " x", "日本語 テキスト", "#" * 50, "12 34 56", "x" * 5000, "!!! ??? ...", words(r, 300), (words(r, 12) + "\n") * 9, "idiot you are a pathetic moron. scum!"]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "a"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], rows[5], (None, base, "en", "b", 1), (None, None, None, None, None)]
    extra = "size long, n_words long, fp long, key long, taken long, lap int, part int, chunk string, feature string, kept boolean, score double, record_type string"
    return spark.createDataFrame([(*x, 1, 2, 3, 4, 5, 6, 7, "c", "f", True, 0.5, "r") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra).repartition(3)


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.limit(0)
