import random

import pytest

LANGS = ("en", "de", None)


def make_docs(seed=3, n=60):
    """(doc_id, text) rows: copies, near copies, shared passages, empty, null, long and odd texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, rows = text(40), []
    for i in range(n):
        t = text(rng.choice([3, 30, 60, 120]))
        if i % 5 == 0:
            t = f"{t}\n{passage}  {text(10)}"
        rows.append((i, t))
    rows += [(100 + i, rows[7 * i][1]) for i in range(5)]  # exact copies
    for i in range(8):  # near copies
        w = rows[3][1].split(" ") if len(rows[3][1].split()) > 50 else (text(100)).split(" ")
        if i == 0:
            base = w
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two three"), (304, "One TWO three"),
             (305, "a " * 700), (306, "x" * 5000), (307, text(6000)), (308, "ab" * 300), (309, "ß日本 語 " * 40)]
    rows += [rows[0], (1, rows[2][1] + " other"), (None, rows[4][1]), (None, "alone in the null row")]
    return rows


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n int, k1 string, rep string, part int, "
          "spans string, score string, copy_no int, shuffle_key string, tie int, chunk string, id string, a int, label int, h int, t int, p int, "
          "cdf string, _gone int, _again int, _mix_count int, _mix_source string, _mix_cdf int, _bad int")


@pytest.fixture(scope="session")
def rows():
    return make_docs()


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    data = [(i, t, LANGS[k % 3], None if k % 4 == 0 else f"s{k % 4}", None if t is None else len(t)) + (None,) * 23 for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
