import pytest

from textbench.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", 4, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared"))
    )
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a frame as tuples, sorted."""

    def collect(df, *columns):
        return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)

    return collect


@pytest.fixture
def frame(spark):
    """A frame of predictions: (model, row_id, true_label, pred_label) from (true, pred) pairs."""

    def make(pairs, model="m"):
        data = [(model, i, t, p) for i, (t, p) in enumerate(pairs)]
        return spark.createDataFrame(data, "model string, row_id bigint, true_label string, pred_label string")

    return make
