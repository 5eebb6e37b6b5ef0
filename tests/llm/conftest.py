import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdeéß漢") for _ in range(R.randint(1, 7))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def awkward():
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, shared passages, periodic text, ties."""
    r = random.Random(5)
    base, passage = prose(200, r), prose(60, r)
    near = base.split()
    near[50] = "changed"
    docs = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "one two"), (10, "one  Two"),
        (11, prose(40, r) + "\n" + passage + " " + prose(40, r)), (12, prose(50, r) + " " + passage), (13, "tick " * 300), (14, "ab" * 400), (15, "ab" * 300),
        (16, prose(20000, r)), (17, passage), (18, passage + " tail"), (19, "é" * 60), (20, "é" * 60 + "!"),
    ]
    docs += [(100 + i, prose(r.randint(0, 120), r)) for i in range(60)]
    docs += [(200 + i, " ".join(near[:i] + ["x"] + near[i + 1 :])) for i in range(0, 200, 5)]
    return docs


@pytest.fixture(scope="session")
def docs():
    return awkward()


@pytest.fixture(scope="session")
def frame(spark, docs):
    """The documents with columns whose names clash with those that operators use."""
    rows = [(d, t, "src", "k", [1], b"x", 7) for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row_key string, spans array<int>, anchors binary, carry int").repartition(3)


@pytest.fixture(scope="session")
def empty(frame):
    return frame.where("false")
