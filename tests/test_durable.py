from threadline import durable

READ = "spark.sql.parquet.columnarReaderBatchSize"


def test_long_texts_are_read_few_at_once_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(READ)
    try:
        spark.conf.set(READ, "4096")
        durable.small_batches(spark)
        assert int(spark.conf.get(READ)) == durable.READ_ROWS
        spark.conf.set(READ, "1000")
        durable.small_batches(spark)
        assert spark.conf.get(READ) == "1000"
    finally:
        spark.conf.set(READ, before)
