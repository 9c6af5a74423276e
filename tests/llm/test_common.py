from types import SimpleNamespace

import pyarrow as pa
import pytest

from rillstone.llm import common


def session(folder, master="local[4]"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(applicationId="app-of-a-test", master=master))


def test_shared_folder():
    assert common.shared_dir(session("hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("hdfs://x/y", "yarn")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        common.shared_dir(session(None, "spark://host:7077"))
    own = common.shared_dir(session(None))
    assert own.startswith("file:///") and common.shared_dir(session(None)) == own


def test_materialize_and_release(spark):
    df = common.materialize(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()
    common.release(df)
    assert not common.materialize(spark.range(0), "none").count()
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rpartition("/")[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_chunks():
    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "text": ["a" * 5, None, "b" * 20, "", "c" * 3, "d" * 9]})
    found = list(common.chunks(iter([batch, batch.slice(0, 0)]), chars=10))
    assert [c.column(0).to_pylist() for c in found] == [[0, 1], [2], [3, 4], [5]]
    assert common.texts_of(found[0]) == ["aaaaa", ""]
