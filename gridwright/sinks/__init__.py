"""Sinks: CSV, TSV, JSON lines, JSON documents, metadata sidecars, run log
(SNK-1..SNK-13, SNK-15).

Row data is always written by the executors (``df.write``). JSON documents
are written in ordered parts with a manifest: their lines, one per record, lie
in files whose name order is the document's order.
"""

from .documents import (document, general_document, inspection_document, json_document, records_of,
                        run_document, write_document, Document, OrderedRecords)
from .files import (CSV_OPTIONS, CSV_READ_OPTIONS, metadata_rows, multi_dataset_csv, output_paths,
                    read_csv, write_csv, write_csv_with_preamble, write_json_lines, write_tsv)
from .ordered import ManifestError, read_ordered, write_ordered
from .runs import RUNS_SCHEMA, append_runs

__all__ = ["CSV_OPTIONS", "CSV_READ_OPTIONS", "RUNS_SCHEMA", "append_runs", "document",
           "general_document", "inspection_document", "json_document", "metadata_rows",
           "multi_dataset_csv", "output_paths", "read_csv", "read_ordered", "records_of", "run_document", "write_csv",
           "write_csv_with_preamble", "write_document", "write_json_lines", "write_ordered", "write_tsv", "Document", "OrderedRecords", "ManifestError"]
