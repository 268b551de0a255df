import collections
import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
EXTRAS = "id key th at n cid sig score label rank bucket row word name low high range copied begin home"


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.translate(LOWER) if lower else data)


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows that operators stumble over: nulls, empty and long texts, ties, repeated rows and ids, clashing columns."""
    prose = " ".join(f"w{k * 7919 % 997}" for k in range(300))
    near = prose.split()
    near[150] = "changed"
    texts = [
        (1, prose),
        (2, prose),  # an exact copy
        (3, " ".join(near)),  # a near copy
        (4, "Some lead in. " + " ".join(prose.split()[40:140]) + " and an end"),  # a shared passage
        (5, None),
        (6, ""),
        (7, "   \n\t "),
        (8, "one"),
        (9, "ONE"),
        (10, "tie tie tie tie tie " * 60),  # one word again and again
        (11, "été ñandú größe — 漢字 " * 30),
        (12, "x" * 5000),  # no white space
        (13, " ".join(f"long{k % 4001}" for k in range(12000))),
        (14, prose[:700]),
        (14, "another text of the same id"),
        (15, "a repeated row " * 3),
        (15, "a repeated row " * 3),
        (None, prose),
        (None, None),
        (16, "tie tie tie tie tie " * 61),
        (17, "<|endoftext|> inside a text"),
    ]
    extras = EXTRAS.split()
    rows = [(i, t, *[k] * len(extras)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in extras)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, key int, th string")


def bag(rows):
    return collections.Counter(map(tuple, rows))
