"""Result documents and table exports."""

from portolan.sinks.documents import plain, result_document, write_json
from portolan.sinks.manifest import read_section, write_sections
from portolan.sinks.tables import write_tables

__all__ = ["plain", "read_section", "result_document", "write_json", "write_sections", "write_tables"]
