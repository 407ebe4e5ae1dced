import pytest

from tillworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:] or (None, None))) for r in rows]
        return spark.createDataFrame(
            [(*r, len(r[1]) if r[1] is not None else None) for r in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded random words, so that texts share nothing by chance."""
    import random

    def words(seed, n, vocabulary=4000):
        rng = random.Random(seed)
        return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]

    return words


#: a NULL text, empty and blank ones, a NULL id, a repeated row, and a very long text
@pytest.fixture(scope="session")
def odd(docs, prose):
    long = " ".join(prose(99, 30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a text without an id"), (4, "twice"),
            (4, "twice"), (5, long), (6, "É ñ ß 漢字 \x00 end")]
    return docs([(*r, "en", None if i % 2 else "s") for i, r in enumerate(rows)])
