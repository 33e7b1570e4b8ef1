"""Sources and sinks of the point-cloud engine."""

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Makes the formats lidar_mcap, ros_bag and npz known to the session, in the calling thread too."""
    from .arrays import NumpyArchive
    from .mcap import LidarMcap
    from .rosbag import RosBag

    for source in (LidarMcap, RosBag, NumpyArchive):
        spark.dataSource.register(source)
    # Formats are looked up in the thread's active session, which only the thread that made the session has by itself;
    # createDataFrame() sets it.
    spark.createDataFrame([], "id int")
