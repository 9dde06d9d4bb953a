import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("the supplied tables are not here")
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Null ids and texts, empty, blank and very long texts, repeated rows, and extra columns of clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    line = " ".join(f"term{k}" for k in range(40))
    texts = [None, "", " \n\t", "a", "The the.", long, long, line, line, f"x\n{line}", "trash " * 30, "1 2 3 !!", "Ünïcode ßtraße 漢字"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, line), (None, None), (7, line), (7, line)]
    rows = [(i, t, "en" if k % 2 else None, 0.5, True, 3, "m", 9) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, score double, held_out boolean, row int, matches string, component int"
    )
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
