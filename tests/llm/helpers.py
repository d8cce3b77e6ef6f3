"""Texts and brute-force versions for the tests of the corpus operators."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rows that every operator on texts must bear: NULL, empty, blank, signs, a very long text, repeated rows, no id.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "?!... ###"), (5, "naïve café — 東京 😀 слово"), (6, "one two " * 30_000),
    (7, "a repeated row of some words"), (7, "a repeated row of some words"), (None, "a row without an id here"),
]


def odd_docs(spark):
    """ODD_TEXTS with columns whose names operators might use themselves."""
    rows = [(i, t, n, f"s{n}", 1.5, n) for n, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, role int, host string, score double, n long")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size=5):
    found = words(text)
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(*[found[i:] for i in range(size)]))


def prose(seed, n, vocabulary=200):
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(stock[min(int(r.paretovariate(0.6)) - 1, vocabulary - 1)] for _ in range(n))


def same_columns(df, out, *new):
    """Columns that an operator passes through and those that it adds."""
    assert [c for c in out.columns if c not in new] == [c for c in df.columns if c not in new]
    assert set(new) <= set(out.columns)
