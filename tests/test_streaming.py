from keyloom.functions import scalar
from keyloom.operators import filters


def test_row_local_operators_take_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a", 1.0, 0.01), ("b", 50.0, 0.5), ("c", 90.0, None)], "gene string, x double, padj double")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = filters.number_filters(stream, "gene", "x", ">", 10)
    out = scalar.transform_columns(out, ["x"], "log2").withColumn("stars", scalar.pvalue_stars("padj"))
    q = out.writeStream.format("memory").queryName("kl_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["gene"] for r in spark.sql("select * from kl_out").collect()) == ["b", "c"]
