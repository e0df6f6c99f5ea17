"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions and turns small join sides into
# broadcasts by their measured size. The force flag lets it split a skewed
# join partition even where that costs one more shuffle: an order or a
# customer may hold a large share of all rows.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What AQE gathers for one task. A join of sums by order sorts and adds up a dozen times in
    # one task, so its memory is a multiple of this.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # What a task scans. Its shuffle keeps all rows of a split sorted, eight times the bytes stored,
    # and the size Spark takes by itself grows with the table up to 128 MB.
    "spark.sql.files.maxPartitionBytes": "32MB",
}


# One shuffle partition per 256 MB of stored input, before AQE coalesces; up to FINE_PARTITIONS
# of them one per 2 MB, so that a task of a medium input stays small, too.
BYTES_PER_PARTITION = 256 * 1024 * 1024
FINE_BYTES, FINE_PARTITIONS = 2 * 1024 * 1024, 1000
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength()


def tune(spark: SparkSession, *tables: str, limit: int | None = None) -> SparkSession:
    """Apply the adaptive settings to a running session, for all its later queries.

    With the paths of the ``tables`` that will be read, the number of shuffle
    partitions is raised to suit their size. It is never lowered: AQE does
    that by itself, but it cannot add partitions that a large input needs.
    There is no limit unless ``limit`` sets one: beyond it partitions grow
    with the input and spill, while the driver's table of map outputs
    stays small.
    """
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    if tables:
        stored = sum(stored_bytes(spark, table) for table in tables)
        needed = max(stored // BYTES_PER_PARTITION, min(stored // FINE_BYTES, FINE_PARTITIONS))
        needed = needed if limit is None else min(needed, limit)
        current = spark.conf.get(INITIAL_PARTITIONS, spark.conf.get("spark.sql.shuffle.partitions"))
        if needed > int(current):
            spark.conf.set(INITIAL_PARTITIONS, str(needed))
    return spark


def build_session(
    app: str = "mercato",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the adaptive settings.

    ``shuffle_partitions`` is the number AQE starts from before it coalesces:
    about one per 200 MB of shuffled data on a cluster, the core count in
    local mode. ``extra`` holds further settings.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(ADAPTIVE)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
