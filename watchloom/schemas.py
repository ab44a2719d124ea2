"""Fixed schemas and fixed vocabulary of the event model."""

from __future__ import annotations

from pyspark.sql import types as T

# The six telemetry sources.
SOURCES = ("sysmon", "auditd", "ollama", "iam", "vault", "api_gateway")

# Log name of a source.
STREAM_PREFIX = "telemetry:"

# Envelope keys that are laid over the payload when present.
ENVELOPE_KEYS = ("envelope_id", "source_type", "host", "ingested_at")

# Output field -> source keys in order of preference.
ALIASES = {
    "host": ("host", "hostname", "computer"),
    "identity": ("identity", "service_identity", "principal"),
    "event_type": ("event_type", "event_name", "type"),
    "action": ("action", "event_name"),
    "process_name": ("process_name", "Image", "image", "process"),
    "process_path": ("process_path", "Image"),
    "parent_process": ("parent_process", "ParentImage"),
    "parent_pid": ("parent_pid", "ParentProcessId"),
    "command_line": ("command_line", "CommandLine", "command", "cmdline"),
    "resource": ("resource", "resource_path", "secret_path"),
    "source_ip": ("source_ip", "src_ip", "client_ip"),
    "user_agent": ("user_agent", "UserAgent"),
    "model": ("model",),
    "prompt": ("prompt",),
    "response": ("response",),
    "ingested_at": ("ingested_at",),
}

# The 22 output columns in order.
EVENT_FIELDS = (
    "event_id", "timestamp", "source_type", "host", "identity", "event_type", "action",
    "process_name", "process_path", "parent_process", "parent_pid", "command_line",
    "resource", "source_ip", "user_agent", "success", "model", "prompt", "response",
    "latency_ms", "ingested_at", "raw_payload",
)

# Defaults.
FIXED_WINDOW_SECONDS = 60
SESSION_GAP_SECONDS = 300
BATCH_SIZE = 100
STREAM_MAX_ENTRIES = 1_000_000
DEFAULT_HOST = "localhost"
MIN_SEQUENCE_LENGTH = 10
Z_THRESHOLD = 3.0
MOVING_AVERAGE_WINDOW = 5
STD_FLOOR = 1e-6

# Extra source keys per source, used only when the caller asks for source-specific reading.
SOURCE_EXTRA_ALIASES = {
    "sysmon": {"identity": ("user",), "parent_process": ("parent_image",), "resource": ("file_path",)},
    "auditd": {"event_type": ("record_type",), "action": ("syscall", "operation"), "resource": ("path",)},
    "iam": {},
    "vault": {},
    "ollama": {},
    "api_gateway": {"resource": ("service",)},
}

ENVELOPE = T.StructType(
    [T.StructField(name, T.StringType()) for name in (*ENVELOPE_KEYS, "raw_payload")]
)

DEAD_LETTER_FIELDS = ("ingest_source", "stage", "error", "line_number", "raw")
