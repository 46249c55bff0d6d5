import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, kept boolean, copies long, fp long, digest string, n int, s double"


def odd_texts():
    """Texts with nulls, emptiness, blanks of all kinds, special strings, long words and near copies."""
    dice = random.Random(7)
    words = [f"w{dice.randrange(500)}" for _ in range(900)]
    long_text = " ".join(dice.choice(["alpha", "beta", "Gamma,", "delta\n", "é日本"]) + str(dice.randrange(9999)) for _ in range(30_000))
    near = [words[:i] + ["changed"] + words[i + 1 :] for i in (5, 400, 880)]
    return [
        None, "", " ", "\n\n", "\t \x0b\x0c\r", "a", "A", "a b", "a  b", "a\nb", " a b", "a b ", "A B C", "a b c", "a b c d", "x" * 5000, long_text, long_text, long_text.upper(),
        "<|endoftext|>", "foo <|endoftext|>bar", "it's we'll 'tis", "one\ttwo three 　 four", "\u0001\u0085 \x1c ok", "日本 語 テスト", " ".join(words), *(" ".join(x) for x in near), "tie one", "tie one", "tieone", "t ie one",
        *("copy of the same passage here" for _ in range(40)), *(f"text number {i} with words {i * i}" for i in range(60)),
    ]


def odd_rows():
    dice = random.Random(3)
    texts = odd_texts()
    rows = [(i, t, dice.choice(["en", "de", None]), dice.choice(["a", "a", "a", "b", "é", None, ""]), None if t is None else len(t), i, -1, None, 5, 1, "d", 0, None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[30], (None, "no id", None, None, 1, None, None, True, None, None, None, None, 0.5), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows in several partitions, with extra columns named like the operators' own."""
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
