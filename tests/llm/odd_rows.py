"""Rows that the tests of this folder share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, token string, box int, row_no int"


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(("ka", "lo", "mi", "ne", "ru", "sta", "vel", "tor")) for _ in range(r.randint(1, 3))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "word", "ein Wort", "x " * 50, "ß ſ K İ é", "\t tab\x0b \x0c\r\n end", "1 2 3 4 5 6 7 8 9 10 11", "|||| |||| ||||", "é" * 3000]


def result(df, key="doc_id"):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[key] is None, r[key] or 0, str(r)))
