"""Documents with nulls, empties, ties, copies, repeated passages and columns whose names operators use inside."""

import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, batch int, id int, node string, n_words string, repeats int, key int"


def make(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or ""), 1, 2, "x", "y", 3, 4) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts, start=0: make(spark, texts, start)


@pytest.fixture(scope="session")
def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = prose(60)
    out = [prose(r.randrange(1, 200)) for _ in range(40)]
    out += [prose(20) + " " + shared + "\n" + prose(15) for _ in range(5)]
    out += [out[0]] * 6 + [shared, "", None, "  \t\n ", "a " * 120, "ÄÖ ü\x1c x\x85y z", "w1", prose(30_000)]
    near = out[41].split()
    return [*out, " ".join([*near[:50], "changed", *near[51:]])]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return make(spark, texts).repartition(3).cache()


def groups(n, linked):
    """Components of 0 .. n - 1 by brute force."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="session")
def components():
    return groups
