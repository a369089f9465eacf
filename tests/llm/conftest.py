import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, score double, maybe int, block int, label string"


def text_of(rnd, n, words=("the", "and", "of", "that", "house", "green", "river", "stone", "light", "under", "over", "seven")):
    return " ".join(rnd.choice(words) + str(rnd.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case, and columns whose names operators use too."""
    rnd = random.Random(11)
    base = [text_of(rnd, rnd.randint(1, 120)) for _ in range(40)]
    texts = [None, "", " ", "\n\t ", "a", "a b", "a  b", "a\tb", "Ünïcode ▁ 日本語 text", "x" * 5000, " lead", "trail ", "<|endoftext|> 's don't", "\x00nul", *base]
    for b in base[:12]:
        w = b.split()
        texts += [b, b.upper(), "\n".join(w), " ".join([*w[:-1], "changed"]), " ".join([*w, "more", "words"]), " ".join(w[: len(w) * 4 // 5])]
    texts.append(text_of(rnd, 6000))  # very long
    out = [(i, t, "en", "s", len(t or ""), "h", 0.5, 1, 2, "l") for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, "a b", "en", "s", 3, "h", 0.5, 1, 2, "l"), (None, base[0], None, "s", 3, "h", 0.5, 1, 2, "l")]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


def collected(df):
    return [r.asDict() for r in df.collect()]
