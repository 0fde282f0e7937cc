"""New contigs as a stream, put to frozen centroids batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bins import nearest_median
from ..operators.kmers import profiles, shares


def assigned_stream(spark: SparkSession, contigs: DataFrame, bins: DataFrame, own: DataFrame, out: str, checkpoint: str, most: float = 0.5):
    """Start a query that writes (contig_id, bin, dist) of streamed contigs (contig_id, seq).

    bins and own (contig_id, p) are the frozen binning; contigs farther than
    ``most`` from every median get a null bin. Each batch writes to a folder of
    its own number, so a batch that is run again replaces its rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        new = profiles(batch).select("contig_id", shares("counts").alias("p"))
        both = own.join(batch.select("contig_id"), "contig_id", "left_anti").unionByName(new)
        found = nearest_median(bins, batch.select("contig_id"), both)
        found.withColumn("bin", F.when(F.col("dist") <= most, F.col("bin"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return contigs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
