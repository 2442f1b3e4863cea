import numpy as np
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in is that for with was on are by this have from", "de": "der die und das nicht ein ist zu von mit sich auch für auf", "fr": "le la et les des que une dans pour qui sur est avec pas"}


def prose(rng, n, lang="en"):
    """Invented words of a language's look, so that texts differ."""
    base = WORDS[lang].split()
    return " ".join("".join(rng.choice(base, rng.integers(1, 4))) if rng.random() < 0.6 else str(rng.choice(base)) for _ in range(n))


def frame(spark, rows):
    """(doc_id, text[, lang]) rows with columns whose names clash with those the operators make."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None, 7.0, "x") for r in rows]
    return spark.createDataFrame(full, COLUMNS + ", score double, key string")


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents of all kinds: prose, junk, toxic, copies, secrets, null, empty, one word, white space, very long."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        text, good, toxic = prose(rng, int(rng.integers(40, 120)), lang), 1, 0
        if i % 8 == 1:
            text, good = " ".join(f"{w}###" for w in text.split()), 0
        if i % 8 == 2:
            toxic, parts = 1, text.split()
            for _ in range(4):
                parts.insert(int(rng.integers(len(parts))), str(rng.choice(["scumbag", "moronic", "pathetic", "loserish"])))
            text = " ".join(parts)
        if i % 12 == 4:
            text += f" password={'%018x' % int(rng.integers(1 << 60))} " + prose(rng, 5)
        rows.append((i, text, lang))
        labels.append((i, good, toxic))
    rows += [(1000, None, None), (1001, ""), (1002, "word"), (1003, " \n\t "), (1004, prose(rng, 20_000)), (None, "no id here at all"), (1005, rows[0][1]), (1005, rows[0][1]), (1006, rows[3][1].replace("the", "teh", 1))]
    return rows, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [(1, "x")]).where("false")
