import pytest

LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture
def save(spark, tmp_path):
    """save(name, rows, schema): writes a table and gives the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def rows_of(df):
    return [r.asDict() for r in df.collect()]
