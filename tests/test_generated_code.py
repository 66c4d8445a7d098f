"""The JVM compiles no method of more than 8000 bytes and runs it slowly for each row instead."""

import pytest
from pyspark.sql import functions as F

from tracehound.functions.scalars import alias
from tracehound.sources.canonical import FAMILIES, canonical

LONGEST = 8000


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_no_method_is_too_long(spark, tmp_path, family):
    rows = spark.createDataFrame([("h", "a", 1, "f", {"Name": "x"})], "host string, artifact string, row_index long, source_file string, row map<string,string>")
    rows.write.parquet(str(tmp_path / "rows"))
    plan = canonical(spark.read.parquet(str(tmp_path / "rows")), family)._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(plan)
    assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < LONGEST


def test_alias(spark):
    df = spark.createDataFrame([({"a": "", "b": "x", "c": "y"},), ({"a": None, "c": "z"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(alias(F.col("m"), "a", "b", "c")).collect()] == ["x", "z", "", ""]
    assert [r[0] for r in df.select(alias(F.col("m"), "a", "c", keep_empty=True)).collect()] == ["", "z", "", ""]
