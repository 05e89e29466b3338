"""Room that the ingest stream's landed files take."""

from confluo.plans import feed_queries
from confluo.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_landed_files_are_packed(spark, monkeypatch):
    sizes = []

    def seen(spark, folder, *rest):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        taken = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        lines = spark.read.text(folder).selectExpr("sum(octet_length(value) + 1)", "count(*)").first()
        sizes.append((taken, lines[0], lines[1]))

    monkeypatch.setattr(feed_queries.jobs, "ingest_events", seen)
    feed_queries.stream_ingest(spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len(sizes) == 2 and all(4 * taken < text and n > rows for taken, text, n in sizes)


def test_joined_rows_are_not_held(spark, monkeypatch):
    """A batch of pairs that is written once goes to its files without being held in memory or on disk before."""
    held, plain = [], jobs.drain

    def drain(out, checkpoint, write, *args, **kwargs):
        def seen(batch, number):
            held.append(batch.is_cached or batch.storageLevel.useMemory)
            write(batch, number)

        return plain(out, checkpoint, seen, *args, **kwargs)

    monkeypatch.setattr(feed_queries.jobs, "drain", drain)
    feed_queries.stream_near(spark, SF)
    assert held and not any(held)
