import random

import pytest

WORDS = "the of and a stone river light carried old house under bright winter morning people walked slowly toward town where market opened early der und die le la et que para con".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names operators use themselves."""
    rnd = random.Random(3)
    prose = " ".join(rnd.choice(WORDS) for _ in range(120))
    texts = [None, "", "   \n\t ", "!!! ### ***", "a", prose, prose, "中文字符 " * 50, " ".join(rnd.choice(WORDS) for _ in range(30_000)), "x" * 5000, "é" * 300 + " Ünïcode ﬁ İ ΑΣ", "🙂 " * 40]
    rows = [(k if k != 4 else None, t, None if k % 5 == 0 else "en", f"s{k}", None, 1, 2, 3.0, "y") for k, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int, fp long, score double, _same string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
