"""Tables in the shared folder and their end."""

from pathlib import Path

from ledgerloom.functions.storage import discard, materialize, release, shared_dir


def test_tables_are_released(spark):
    release(spark)
    one, two, three = (materialize(spark.range(n), "released") for n in (3, 4, 5))
    folders = [Path(f.partition(":")[2].replace("//", "/")).parent for t in (one, two, three) for f in t.inputFiles()[:1]]
    assert all(f.is_dir() for f in folders) and two.count() == 4
    discard(one)
    assert [f.exists() for f in folders] == [False, True, True]
    assert release(spark) == 2 and release(spark) == 0
    assert not any(f.exists() for f in folders)
    assert Path(shared_dir(spark)).is_dir()
