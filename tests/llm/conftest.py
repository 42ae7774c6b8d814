import pytest

SF = "/root/testdata/sf0.001"

WORDS = "the of and to in is that it for on was with as be at by this from or an Ünï été año ß x".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text)"""
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def messy():
    """Rows with copies, near copies, shared passages, nulls, empty and long texts, odd white space."""
    import random

    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))
    passage, line = say(60), say(9)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two three"), (5, "one two three"), (6, say(4000))]
    base = say(120).split()
    for i in range(12):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(99))
        rows.append((10 + i, " ".join(w)))
    rows += [(30 + i, f"{say(20)}\n{passage}\r\n{say(15)}\n{line}") for i in range(8)]
    rows += [(40 + i, f"{line}\n{say(5 + 10 * i)}") for i in range(8)]
    rows += [(50, rows[7][1].upper()), (51, rows[7][1]), (52, rows[7][1]), (53, "same " * 300), (54, "same " * 280), (55, rows[6][1])]
    return rows
