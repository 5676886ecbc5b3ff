"""Sources of import pipelines, and what reads and writes their tables and exports."""

from .export import MANIFEST, ChunkWriter, ExportedFile, as_dicts, export_csv, export_jsonl, write_manifest
from .tables import INGEST_ROWS, LARGE_FILE_BYTES, RUN_ROWS, TableWriter, batches, has_rows, is_large, publish, row_count, row_count_many, snapshot

__all__ = [
    "INGEST_ROWS", "LARGE_FILE_BYTES", "MANIFEST", "RUN_ROWS", "ChunkWriter", "ExportedFile", "TableWriter", "as_dicts", "batches", "export_csv", "export_jsonl",
    "has_rows", "is_large", "publish", "row_count", "row_count_many", "snapshot", "write_manifest",
]
