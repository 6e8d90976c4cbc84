import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, hash string, node int, n int, token string"
SF = "/root/testdata/sf0.001"


def messy_rows():
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "ÜBER", "naïve", "it's", "we'll", "12", "a.b", "x-y", "日本語", "😀", "ß", " ", "é"]
    line = "A line that many documents share, word for word, as it stands."
    rows = []
    for i in range(120):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8)))
        if i % 4 == 0:
            text += "\n  " + (line.upper() if i % 8 == 0 else line) + "\t"
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S", None])))
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n\t\r\x0b\x0c ", "en", "s1"), (203, "one", "en", "s2"), (204, "<|endoftext|> a <|startoftext|>b <|x", "en", "s2")]
    rows += [(205, " ".join(rng.choice(words) for _ in range(30_000)), "en", "s3"), (206, "x" * 50_000, "en", "s3"), (207, "\n" * 3000, "en", "s3"), (208, "a  b\n\nc \x1c d e\u0085f", "de", "s1")]
    rows += [(None, "no id here", "en", "s1"), (None, None, None, None), rows[0], rows[0], rows[3], (300, rows[3][1], "de", "s2"), (301, rows[3][1], "de", "s2")]
    return [(*r, len(r[1] or ""), 7, "clash", 1, 2, None) for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(spark):
    """The same without repeated or null ids."""
    seen, out = set(), []
    for r in messy_rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return spark.createDataFrame(out, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
