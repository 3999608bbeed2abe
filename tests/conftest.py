import pytest

from runsight.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(monkeypatch):
    """Cut every run into chunks of a few rows, so that values have to be carried between them."""
    from runsight.plans import running

    monkeypatch.setattr(running, "HOT_ROWS", 10)
    monkeypatch.setattr(running, "CHUNK_ROWS", 12)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
