import random
import re

import pytest

CUT = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text):
    return [w for w in CUT.split(text or "") if w]


@pytest.fixture(scope="session", autouse=True)
def code(spark):
    from demandlab.llm.common import ship_code
    ship_code(spark)


def make_docs(n=60, seed=5):
    """(doc_id, text, source) rows: copies, near copies, nulls, blanks, one long text, repeated rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(vocab) for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 4)))
        rows.append((i * 3 + 1, text, r.choice(["a", "b", "c", None])))
    for k in range(12):
        base = rows[k][1].split(" ")
        edited = list(base)
        for _ in range(k % 4):
            edited[r.randrange(len(edited))] = r.choice(vocab)
        rows.append((1000 + k, " ".join(edited), "b"))
    rows += [(2000, None, "a"), (2001, "", None), (2002, " \t\r\n ", "c"), (2003, "one", "c"), (2004, "One", "z"),
             (2005, "two words", "z"), (2006, " ".join(r.choice(vocab) for _ in range(6000)), "a"), (2007, "日本 テスト\n\n🙂 ok", "a"),
             (None, rows[0][1], "a"), (None, None, None), rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """The rows as a table with extra columns whose names clash with inner ones."""
    wide = [(i, t, s, None if t is None else len(t), "x", 7, 0.5, "k") for i, t, s in doc_rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, n_chars int, label string, size long, "
                                       "score double, set_key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
