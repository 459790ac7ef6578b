import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, node string"


@pytest.fixture(scope="session")
def texts():
    """Texts with families of near copies, odd white space, other scripts, and a very long one."""
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)] + ["Größe", "naïve", "漢字", "İstanbul", "it's", "123,456", "x" * 300]
    out = [None, "", " \t\n", "one", "one  ONE", "a b", "A\u00a0B", "a b c d e"]
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        for k in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(k):
                t[r.randrange(len(t))] = r.choice(vocab)
            out += [" ".join(t)] * r.choice((1, 1, 2))
    out.append(" \n".join(r.choice(vocab) for _ in range(60_000)))
    out.append("y" * 700_000)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 11 == 3 else f"s{i % 5}", len(t or ""), "x", None, "y") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "a text without an id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
