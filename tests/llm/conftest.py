import random

import pytest

#: Texts that every operator must take: null, empty, blank, one word, ties and copies, marks, scripts, one long word.
ODD = [None, "", " \n\t ", "word", "a b c d", "same text here", "same text here", "\x01\x02 \x00", "日本語 テキスト 🙂 é", "x" * 30_000, "ab " * 5_000, "q\n" * 3_000]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts in a table with more columns, some named as the operators' own, a repeated row and a null id."""
    rows = [(i, t, "en", "src0", len(t or ""), -1, "k", 0.5) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "same text here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n_words int, kept string, rank double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text): fresh texts, exact and near copies, a shared passage."""
    rng = random.Random(12)
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage, docs = fresh(60), []
    for i in range(120):
        t = fresh(rng.randint(1, 160))
        if i % 5 == 0:
            t[len(t) // 2 : len(t) // 2] = passage
        docs.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(t)
            for _ in range(rng.choice([0, 1, 2])):
                near[rng.randrange(len(near))] = rng.choice(words)
            docs.append(near)
    rng.shuffle(docs)
    return [(i, (" " if i % 3 else "\n").join(t)) for i, t in enumerate(docs)]


@pytest.fixture(scope="session")
def corpus_df(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
