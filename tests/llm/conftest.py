import pytest

#: Rows with every awkward case: nulls, empty and long texts, ties, repeated rows, copies, and names that clash.
PASSAGE = " ".join(f"shared{i % 37}x{i}" for i in range(70))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, g long"


def texts():
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(6000))
    rows = [
        (1, f"alpha beta {PASSAGE} gamma", "en"), (2, f"The delta {PASSAGE} epsilon ZETA", "en"), (3, None, "fr"), (4, "", None), (5, "   \t\n ", "en"), (6, "x", "de"),
        (7, f"alpha beta {PASSAGE} gamma", "en"), (8, long, "en"), (9, long + " tail", None), (10, "é ü ñ 漢字 don't stop", "fr"), (11, "a " * 300, "es"), (12, "a " * 200 + "b", "es"),
        (None, f"lost {PASSAGE}", "en"), (None, None, None), (13, "12 345 !!", "en"), (14, "the cat sat on the mat and looked at the dog over there now", "en"), (14, "the cat sat on the mat and looked at the dog over there now", "en"), (14, "another text with the same number", None), (15, "<|endoftext|> is only text", "en"),
        (16, f"{PASSAGE[:300]} broken off {PASSAGE[300:]}", "en"), (2**40, f"huge id {PASSAGE}", "en"), (-5, f"small id {PASSAGE} end", "en"),
    ]
    return [(i, t, lang, None if i == 6 else "s", len(t or ""), 0.5, 7, None) for i, t, lang in rows]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
