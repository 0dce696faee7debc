import random

import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "é", "Straße", "x.y", "a,b"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty and blank texts, copies, near copies, shared passages, a long text, personal data, white space."""
    rng = random.Random(7)
    out = [None, "", "  \n\t ", "one", "one two", "One TWO"]
    base = [prose(rng, rng.randint(25, 160)) for _ in range(60)]
    out += base
    out += base[:5] * 2
    for text in base[5:25]:
        words = text.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    passage = prose(rng, 45)
    out += [f"{prose(rng, 12)} {passage} {prose(rng, 9)}" for _ in range(12)]
    out += ["echo " * 90, "a b c " * 40, passage, prose(rng, 9000), "\x85nbsp\xa0one\x1c two three " * 12]
    out += ["mail a.b@x-y.co.uk, or c@d.e! 10.0.0.256 10.1.2.3 4111 1111 1111 1111 00 +1 (375) 555-4393 z@", "4111111111111111 and 4111-1111-1111-1112 +12 34", "x@@y.z +1.2.3.4.5.6.7.8.9.0 1.2.3.4.5"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns, some named like columns the operators use."""
    rows = [(i, t, "en" if i % 3 else None, "src0", len(t or "")) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return table.withColumns({c: F.lit("z") for c in ("key", "n", "place", "score", "words", "first", "a", "b", "part", "kept", "rep", "shard")})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
