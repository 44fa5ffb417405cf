"""Option presets for the two phases: bulk load (snapshot) and low latency (streaming)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """How much one micro-batch takes in, how often it runs, how big a sink write is."""

    name: str
    bootstrap_mode: str
    max_batch_size: int
    max_queue_size: int
    poll_interval_ms: int
    fetch_size: int
    sink_batch_size: int
    sink_tasks: int
    files_per_trigger: int

    # The two tuning profiles.
    @staticmethod
    def snapshot() -> "Profile":
        return Profile("snapshot", "initial", 4096, 16384, 100, 10240, 5000, 4, 1000)

    @staticmethod
    def streaming() -> "Profile":
        return Profile("streaming", "no_data", 256, 8192, 50, 10240, 500, 2, 10)

    def file_options(self) -> dict[str, str]:
        return {"maxFilesPerTrigger": str(self.files_per_trigger)}

    def kafka_options(self) -> dict[str, str]:
        return {"maxOffsetsPerTrigger": str(self.max_queue_size), "minPartitions": str(self.sink_tasks)}

    def jdbc_read_options(self, column: str, low: int, high: int, partitions: int) -> dict[str, str]:
        return {
            "fetchsize": str(self.fetch_size),
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }

    def jdbc_write_options(self) -> dict[str, str]:
        return {"batchsize": str(self.sink_batch_size), "numPartitions": str(self.sink_tasks)}

    def trigger(self, continuous: bool) -> dict:
        if not continuous:
            return {"availableNow": True}
        return {"processingTime": f"{self.poll_interval_ms} milliseconds"}
