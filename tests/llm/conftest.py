import random

import pytest

VOCABULARY = [a + b + c for a in ("ka", "lo", "mi", "ter", "su") for b in ("na", "re", "vo", "shi") for c in ("", "n", "st", "ra")]
#: id, size and so on clash with names that operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, key string, host string, band int, bucket long, copy boolean, starts string, ends string, rep long, node long, root long, digest string, target double, taken long, shard long, k long, new long, ident long, family long, weight double, n long, score double, toxic int"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + (".\n" if rng.random() < 0.05 else "") for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    long_text = prose(rng, 30_000)
    near = prose(rng, 300).split(" ")
    texts = [None, "", "  \n\t ", "one", "two words", "ONE", "\n\n\n", "Ünïcode žluťoučký 日本語 テキスト " * 8, long_text, long_text, long_text + " end", "#*$ %&|<> " * 40, "a " * 500, "a" * 5000]
    texts += [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in range(0, 200, 20)] + [" ".join(near)] * 5
    texts += [prose(rng, rng.randint(1, 400)) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [prose(rng, 50) + " " + passage + " " + prose(rng, 50) for _ in range(6)]
    out = [(k * 3, t, [None, "en", "de", "fr"][k % 4], [None, "s1", "s1", "s1", "s2"][k % 5]) for k, t in enumerate(texts)]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    n = COLUMNS.count(",") + 1
    return spark.createDataFrame([(*r, *(None,) * (n - len(r))) for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, copies, and columns with clashing names; ids are unique."""
    return frame(spark, edge_rows()).cache()


@pytest.fixture(scope="session")
def doubled(spark):
    """The same with repeated rows, ids with several texts, and null ids."""
    rows = edge_rows()
    return frame(spark, rows + rows[:20] + [(3, "another text of this id", "en", "s1"), (None, "no id here at all", None, None), (None, "no id here at all", None, None), (None, None, None, None)]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
