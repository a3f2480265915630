import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, tab int, score double, key_ int"


def prose(rng, n, stock=400):
    return [f"w{rng.randrange(stock)}x" for _ in range(n)]


def messy_rows(seed=0):
    """Nulls in every column, empty and blank texts, copies, near copies, shared passages, repeated rows and ids, a very long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = [" ".join(b) for b in base]
    texts += [texts[0], texts[0], texts[1], texts[2] + " end", " ".join(base[3][:10] + passage + base[3][10:]), " ".join(base[4] + passage), "  \n\t ".join(base[5]), " ".join(prose(rng, 30_000))]
    near = list(base[6] * 2)
    texts.append(" ".join(near))
    near[3] = "other"
    texts.append(" ".join(near))
    texts += ["", "", " \n ", None, None, "ÄÖ Ü ß 日本 é x", "a", "a b", "a b c", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more']
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, None if t is None else len(t), "k", k, 0.5, 1) for k, t in enumerate(texts)]
    return rows + [(None, "no id here", None, None, None, None, None, None, None), rows[7], rows[7], (7, "another text under the same id", None, None, 3, None, None, None, None)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def tidy(spark):
    """Unique ids."""
    rows = {r[0]: r for r in messy_rows(1) if r[0] is not None}
    return spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark_items(spark):
    rng = random.Random(99)
    items = [" ".join(prose(rng, n, 5000)) for n in (15, 20, 40, 57)] + ["five short words stand here", "", None]
    return spark.createDataFrame(list(enumerate(items)) + [(None, items[0])], "item_id long, text string")
