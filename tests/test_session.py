import os

from querent import session


def test_stored_tables_keep_schema_and_go_when_cleared(spark):
    empty = session.stored(spark.range(0).selectExpr("id", "cast(null as array<int>) a"), "none")
    assert empty.columns == ["id", "a"] and empty.count() == 0
    df = session.stored(spark.range(5), "five")
    assert df.count() == 5
    folder = session.stored_dir(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    session.clear(spark)
    assert not os.path.isdir(folder)


def test_a_set_folder_is_used():
    class Held:
        conf = {"spark.checkpoint.dir": "file:///shared/by/all"}

    assert session.shared_dir(Held()) == "file:///shared/by/all"
