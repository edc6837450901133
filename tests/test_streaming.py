"""Row-wise operators keep no state, so they work on a stream as they are."""

from pyspark.sql import functions as F

from textbench.functions.parsing import parse_output
from textbench.functions.prompts import build_prompt
from textbench.operators.labels import encode_table


def test_row_wise_operators_on_a_stream(spark, tmp_path, rows):
    data = [(i, t, l) for i, (t, l) in enumerate([("so much love", "love"), ("what a joy", "surprise"), (None, None)])]
    path = str(tmp_path / "in")
    spark.createDataFrame(data, "row_id bigint, text string, label string").write.parquet(path)

    def job(df):
        return encode_table(df).select(
            "row_id", "label_id", "known", parse_output(F.col("text")).alias("pred_label"), build_prompt(F.col("text")).alias("prompt")
        )

    batch = spark.read.parquet(path)
    stream = job(spark.readStream.schema(batch.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("row_wise").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("row_wise")) == rows(job(batch))
