import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and a clashing extra column."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "x59")
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, near, "de", "b"), (4, None, "en", "a"), (5, "", "de", None),
        (None, "one two three", None, "b"), (7, "one two three", "fr", "b"), (8, "  \n\t ", None, "a"),
        (9, "cc by cc by all rights reserved. Licensed under the Apache License, Version 2.0", "en", "c"),
        (10, "über straße été niño …", "fr", "c"), (11, "z" * 5000, "en", "c"), (12, " ".join(["la"] * 3000), "es", "a"),
        (13, base, "en", "a"), (13, base, "en", "a"), (14, "日本語 テキスト", None, "a"), (15, "a\nb\na\n\na", "en", "b"),
    ]
    return spark.createDataFrame([(*r, f"extra{i}", i) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_words string, file int")
