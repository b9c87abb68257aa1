import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def documents(spark):
    """A small table with the awkward cases: nulls, empty texts, repeated rows, copies, a long text, a column more."""
    import random

    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(60), say(12)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "don't stop"), (5, "a " * 120), (6, say(3000))]
    for k in range(7, 60):
        parts = [say(rng.randint(3, 70)) for _ in range(rng.randint(1, 4))]
        if k % 5 == 0:
            parts.insert(1, passage)
        if k % 4 == 0:
            parts.append(line)
        rows.append((k, "\n".join(parts)))
    for k in range(60, 75):  # copies and near copies
        words = rows[10 + k % 6][1].split(" ")
        if k % 3 and len(words) > 3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows.append((75, rows[6][1] + " tail"))
    rows = [(d, t, "x") for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, _uid string").repartition(3), {d: t for d, t, _ in rows}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
