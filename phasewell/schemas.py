"""Schemas of the engine's tables."""

from __future__ import annotations

ACCESS = ("Uncl", "Rand", "Seq", "Str")
JOB_CSV = "_idx INT, timestamp DOUBLE, bytesRead BIGINT, bytesWritten BIGINT, processCount BIGINT, ioActiveProcessCount BIGINT"
SIGNALS = (
    "workflow_id STRING, job_id STRING, idx INT, ts_s BIGINT, bytesRead BIGINT, bytesWritten BIGINT, operationRead BIGINT, operationWrite BIGINT, "
    + ", ".join(f"access{p}{d} BIGINT" for d in ("Read", "Write") for p in ACCESS)
)
PHASE_FEATURES = (
    "job_id STRING, nodes INT, read_volume DOUBLE, write_volume DOUBLE, read_io_pattern STRING, write_io_pattern STRING, "
    "read_io_size DOUBLE, write_io_size DOUBLE, ioi_bw DOUBLE"
)
REPRESENTATION = (
    "job_id BIGINT, phase INT, event BIGINT, read_volume DOUBLE, read_bw DOUBLE, write_volume DOUBLE, write_bw DOUBLE, "
    "read_pattern STRING, write_pattern STRING, read_operations BIGINT, write_operations BIGINT"
)
EDGES = "workflow_id STRING, src STRING, dst STRING, type STRING, delay BIGINT"
TIERS = "name STRING, idx INT, capacity DOUBLE, kind STRING, persistent_tier STRING, read_seq DOUBLE, read_rand DOUBLE, write_seq DOUBLE, write_rand DOUBLE"
APP_PHASES = "app STRING, i INT, compute DOUBLE, read DOUBLE, write DOUBLE, read_bw DOUBLE, write_bw DOUBLE"
LOG = (
    "trial_id BIGINT, app STRING, type STRING, cpu_usage INT, t_start DOUBLE, t_end DOUBLE, bandwidth_concurrency INT, bandwidth DOUBLE, "
    "phase_duration DOUBLE, volume DOUBLE, tiers ARRAY<STRING>, data_placement STRUCT<placement: STRING, source: STRING>, "
    "init_level MAP<STRING, DOUBLE>, tier_level MAP<STRING, DOUBLE>"
)
#: Columns of positional JSON files by the file's name.
POSITIONAL = {
    "volume": ("timestamp", "bytesRead", "bytesWritten"),
    "operationsCount": ("timestamp", "operationRead", "operationWrite"),
    "accessPatternRead": ("timestamp", "accessRandRead", "accessSeqRead", "accessStrRead", "accessUnclRead"),
    "accessPatternWrite": ("timestamp", "accessRandWrite", "accessSeqWrite", "accessStrWrite", "accessUnclWrite"),
} | {
    f"ioSizes{d}": ("timestamp", *(f"ioSizes{d}{b}" for b in ("0B_16B", "16B_4KB", "4KB_128KB", "128KB_1MB", "1MB_16MB", "16MB_128MB", "128MB_up")))
    for d in ("Read", "Write")
}
