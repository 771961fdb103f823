import itertools

import pytest

_numbers = itertools.count()


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder for written tables, where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def documents(spark):
    """A frame of (doc_id, text, source) rows with further columns, some with clashing names."""

    def make(rows, **more):
        schema = "doc_id long, text string, source string, spans int, `_hash` string, `n` int, component_id string"
        return spark.createDataFrame([(*r, *(None,) * (3 - len(r)), 1, "x", None, "y") for r in rows], schema)

    return make
