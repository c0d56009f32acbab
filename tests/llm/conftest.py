import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, words string, score string, doc long, found int"


def rows_of(texts, start=0):
    return [(start + i, t, "en", "s", None if t is None else len(t), 1, "w", "x", 7, 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null and repeated ids, repeated rows, ties, one long text, shared passages, control characters."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "of", "and", "é", "日本"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(40), prose(120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", "   \n\t ", "one", "two words", prose(4), passage, prose(30) + " " + passage + " " + prose(20), passage + "\n" + prose(9),
        base, base, " ".join(near), base.upper(), prose(8000), "same line\n" * 30, "a b c d e " * 20, "x" * 5000, "mail a@b.co \x01\x02 end", prose(60),
    ]
    rows = rows_of(texts)
    rows += [rows[9], rows[9]]  # the same row again
    rows += [(3, prose(25), "en", "s", 1, 1, "w", "x", 7, 0), (None, base, "en", "s", 1, 1, "w", "x", 7, 0), (None, None, None, None, None, None, None, None, None, None)]
    return rows
