import random

import pytest

WORDS = "the of and river stone light under cloud walks slowly Bright green over 7 hills café # $x | a".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _row string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, repeats, ties, nulls and odd texts."""
    rng = random.Random(5)
    out = []
    add = lambda t, lang="en", source="s1": out.append((len(out), t, lang, source, 0, 0.5, "x"))
    passage = prose(rng, 60)
    for k in range(30):
        add(prose(rng, rng.randint(30, 120)), source=f"s{k % 4}")
    base = prose(rng, 90).split()
    for k in range(14):  # near copies
        w = list(base)
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 99)}"
        add(" ".join(w), source=None)
    for k in range(6):  # exact copies
        add(out[3][1].upper() if k == 5 else out[3][1])
    for _ in range(6):  # a shared passage
        add(f"{prose(rng, 40)}\n{passage} {prose(rng, 40)}")
    add("the The the " * 40)
    add("again and again it goes on " * 12)
    add("one two")
    add("One two")
    add("alone")
    add("\t \n ")
    add("")
    add(None)
    add("!!! 123 ###", None, "é")
    add(prose(rng, 4000))  # a very long text
    add("line a b c\nline a b c\n\nline a b c\nother " + prose(rng, 30))
    out.append((5, prose(rng, 50), "en", "s1", 0, 0.5, "x"))  # an id that occurs twice
    out.append((None, prose(rng, 50), "en", "s2", 0, 0.5, "x"))
    out.append((None, passage, "en", "s2", 0, 0.5, "x"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
