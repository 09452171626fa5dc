"""Small corpora for the operators."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in is was for with on".split()


def sentence(rng, n=12):
    words = [rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice(["ka", "lo", "mi", "ter", "ven", "sor", "un"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def clean(rng, lines=8):
    return "\n".join(sentence(rng) for _ in range(lines))


def junk(rng, kind):
    words = clean(rng).split()
    return [" ".join(w + "%%%" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join([rng.choice(words)] * 60 + [rng.choice(words)] * 40), " | ".join(w for w in words if w not in COMMON)][kind % 4]


@pytest.fixture(scope="session")
def corpus():
    """(documents, labels): clean ones, junk, exact and near copies, shared passages and odd rows."""
    rng = random.Random(5)
    docs = [(i, clean(rng, rng.randint(6, 14)), "en" if i % 3 else "de", f"s{i % 4}", None) for i in range(400)]
    docs += [(400 + i, junk(rng, i), "en", "s1", 3) for i in range(80)]
    docs += [(500 + i, docs[i][1], "en", "s2", 1) for i in range(10)]
    for i in range(20, 40):
        words = docs[i][1].split(" ")
        words[len(words) // 2] = "changed"
        docs.append((500 + i, " ".join(words), "en", "s0", 1))
    passage = "\n".join(sentence(rng, 20) for _ in range(4))
    docs += [(600 + i, clean(rng, 3) + "\n" + passage + "\n" + clean(rng, 3), "en", "s3", 1) for i in range(5)]
    docs += [(700, None, None, None, None), (701, "", "en", None, 0), (702, "one", "en", "s0", 3), (703, " \n\t ", "xx", "", 4), (None, clean(rng), "en", "s1", 1), (704, "word " * 30_000, "en", "s1", 1), (0, docs[0][1], "de", "s0", None), (705, "a\n\n\n\n\nb", "en", "s0", 1)]
    labels = [(i, 1, 0) for i in range(0, 400, 2)] + [(i, 0, 0) for i in range(400, 480, 2)] + [(None, 1, 0), (1, None, None), (3, 1, 0), (3, 0, 0)]
    return docs, labels


@pytest.fixture(scope="session")
def tables(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="session")
def documents(spark, tables):
    """The documents with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{tables}/documents.parquet")
    for c in ("k", "h", "n", "node", "size", "kept", "n_lines", "ids", "s", "copies", "at", "nll"):
        df = df.withColumn(c, F.lit("clash"))
    return df
