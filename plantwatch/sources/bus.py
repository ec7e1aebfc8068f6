"""Topics of the message bus as tables of binary `value` rows.

`format` is a parameter: "kafka" on a cluster with the connector, or a file
format ("parquet", "json") over one folder per topic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plantwatch.functions import decode
from plantwatch.params import DEFAULTS, Params
from plantwatch.schemas import TOPICS

# Records are keyed by machine, so a machine's offsets are its order of arrival.
KAFKA = ["value", "offset AS seq", "timestamp AS arrived_at"]


@dataclass(frozen=True)
class Bus:
    spark: SparkSession
    format: str = "kafka"
    location: str = ""               # broker list, or parent folder of the topics
    options: dict = field(default_factory=dict)
    # What one epoch takes at most, so that no machine's share of it can grow without bound.
    records_per_epoch: int = 20_000_000
    files_per_epoch: int = 1_000

    def _topic(self, name: str) -> str:
        return TOPICS.get(name, name)

    def _kafka(self, reader, name):
        return (reader.format("kafka").option("kafka.bootstrap.servers", self.location)
                .option("subscribe", self._topic(name)))

    def _files(self, reader, name):
        """A file topic has one folder per epoch of its writer."""
        return (reader.format(self.format).schema("value BINARY")
                .option("recursiveFileLookup", True).options(**self.options)
                .load(f"{self.location}/{self._topic(name)}"))

    def stream(self, name: str) -> DataFrame:
        """New records only; an ongoing query resumes from its checkpoint."""
        reader = self.spark.readStream
        if self.format == "kafka":
            return (self._kafka(reader, name).option("startingOffsets", "latest")
                    .option("maxOffsetsPerTrigger", self.records_per_epoch)
                    .options(**self.options).load().selectExpr(*KAFKA))
        return self._files(reader.option("maxFilesPerTrigger", self.files_per_epoch), name)

    def table(self, name: str) -> DataFrame:
        """What the topic holds now, as a bounded table."""
        reader = self.spark.read
        if self.format == "kafka":
            return self._kafka(reader, name).options(**self.options).load().selectExpr(*KAFKA)
        return self._files(reader, name)

    def publish(self, df: DataFrame, name: str, epoch_id: int | None = None) -> None:
        """Append records (columns `value` and, optionally, `key`) to a topic.

        Brokers get them at least once. In a file topic an epoch is one folder, and
        a replayed epoch whose folder is complete writes nothing.
        """
        if self.format == "kafka":
            (df.write.format("kafka").option("kafka.bootstrap.servers", self.location)
             .option("kafka.acks", "all").option("topic", self._topic(name))
             .options(**self.options).save())
            return
        path = f"{self.location}/{self._topic(name)}"
        out = df.select(df["value"].cast("binary").alias("value"))
        if epoch_id is None:
            out.write.format(self.format).mode("append").save(path)
        elif not self._published(f"{path}/epoch_id={epoch_id}"):
            out.write.format(self.format).mode("overwrite").save(f"{path}/epoch_id={epoch_id}")

    def _published(self, folder: str) -> bool:
        """Whether an epoch's folder was committed: a replay must not give its readers new files."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def publish_stream(self, df: DataFrame, name: str, checkpoint: str,
                       p: Params = DEFAULTS, **trigger) -> StreamingQuery:
        writer = (df.writeStream.option("checkpointLocation", checkpoint)
                  .trigger(**(trigger or {"processingTime": p.trigger})))
        if self.format == "kafka":
            return (writer.format("kafka").option("kafka.bootstrap.servers", self.location)
                    .option("topic", self._topic(name)).options(**self.options).start())
        return writer.foreachBatch(lambda batch, epoch: self.publish(batch, name, epoch)).start()

    # ---- decoded topics ------------------------------------------------------
    def flow(self) -> tuple[DataFrame, DataFrame]:
        """Sensor alerts and maintenance actions, as the event flow takes them."""
        return self.ml_alerts(), self.maintenance()

    def sensors(self) -> DataFrame:
        return decode.sensors(self.stream("sensors"))

    def orders(self, p: Params = DEFAULTS) -> DataFrame:
        return decode.orders(self.stream("orders"), p)

    def ml_alerts(self) -> DataFrame:
        return decode.alerts(self.stream("ml_alerts"))

    def maintenance(self) -> DataFrame:
        return decode.maintenance(self.stream("maintenance"))
