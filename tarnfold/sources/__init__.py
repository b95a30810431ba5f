"""Where documents come from and go: the versioned log, NDJSON, Parquet backups."""

from .log import SCHEMA, Log, compacted, current_documents, index_scores, latest_versions, live_documents, seconds_left
from .ndjson import documents_of_events, export_ndjson, import_ndjson

__all__ = ["SCHEMA", "Log", "compacted", "current_documents", "documents_of_events", "export_ndjson", "import_ndjson", "index_scores", "latest_versions", "live_documents", "seconds_left"]
