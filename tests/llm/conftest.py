import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, node string, target double"


def _rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    base = [text(rng.randint(3, 120)) for _ in range(40)]
    for i in range(150):
        t = rng.choice(base)
        if i % 3 == 0:
            ws = t.split()
            for _ in range(rng.randint(1, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            t = " ".join(ws)
        rows.append([i * 7 % 151, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None])])
    special = [None, "", " \t\n", "!!! 123 ???", "word", "Ünï ÇÖDÉ ß 漢字 \x1c\x85\xa0 end", "It's  we'll\n\n 12½ ²  the end ", "A B a b", "MIT License. Apache License, GNU General Public License mit  license", "x" * 5000, text(20_000)]
    rows += [[200 + i, t, "en", "b"] for i, t in enumerate(special)]
    rows += [rows[3], rows[3], [None, "null id here now", None, None], [None, None, None, None]]
    return [(d, t, la, s, None, 1, "n", 0.5) for d, t, la, s in rows]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
