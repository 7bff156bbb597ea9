from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, fp string, size string, score string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with every odd case: NULLs, empty, blank and long texts, repeated rows, clashing columns."""
    prose = "The quick brown fox jumps over the lazy dog near the river bank. "
    texts = [
        (1, "".join(f"{prose.strip()} {i} words{i} of text{i * 7} here. " for i in range(30))),
        (2, "".join(f"{prose.strip()} {i} words{i} of text{i * 7} here. " for i in range(30))),
        (2, "".join(f"{prose.strip()} {i} words{i} of text{i * 7} here. " for i in range(30))),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one"),
        (7, "say say say say " * 40),
        (8, "\n".join(["same line again"] * 30)),
        (None, "no id at all"),
        (None, None),
        (9, "été 漢字 ☃\U0001f600   nbsp \x85 x▁y <|endoftext|> "),
        (10, "x" * 50_000),
        (11, " ".join(f"w{i % 997}" for i in range(30_000))),
        (12, "### !!! " * 60),
    ]
    rows = [
        (d, t, "en", None if d in (3, 9) else f"s{(d or 0) % 3}", len(t or ""), 1, "f", "big", "high") for d, t in texts
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
