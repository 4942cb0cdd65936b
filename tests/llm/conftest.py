import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, blob binary, kind int, x string, score string, ids string, size string, h int, component string"


def corpus(n=60, seed=3):
    """Documents with exact and near copies, shared passages, repeated lines, blanks, nulls and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(2, 7))) for _ in range(900)] + ["The", "OF", "é", "naïve", "日本"]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = say(60)
    base = say(150).split(" ")
    texts = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            texts.append(" ".join(base))
        elif kind == 1:
            t = list(base)
            for _ in range(r.randint(1, 6)):
                t[r.randrange(len(t))] = "new%d" % r.randrange(10**6)
            texts.append(" ".join(t))
        elif kind == 2:
            texts.append(say(30) + "\n" + passage + "\t" + say(20))
        elif kind == 3:
            texts.append("\n".join([say(8)] * 4 + [say(9)]))
        else:
            texts.append(say(r.randint(1, 120)))
    texts += [None, "", "  \n\t ", "one two", "one two", "a b c d e", "a b c d e", say(9000), "A B c D e", "<|endoftext|>x  y", "12 34 # $"]
    rows = [(i, t, ["en", "fr", None, "de"][i % 4], ["s1", "s2", None, "s0", "s1"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    more = ("b", bytearray(b"z"), 7, "x", "s", "i", "z", 1, "c")
    return spark.createDataFrame([r + more for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, nulls everywhere."""
    same = (5, "alpha beta gamma delta epsilon zeta", "en", "s", 3, "b", None, None, None, None, None, None, None, None)
    return spark.createDataFrame([same, same, (None, "alpha beta", *[None] * 12), (7, *[None] * 13), (None, *[None] * 13)], SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
