import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """A shared folder for written tables and archives."""
    path = str(tmp_path_factory.mktemp("shared"))
    spark.conf.set("sextant.shared.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
