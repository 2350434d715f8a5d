"""quillstone: conversation and event-log analytics written for PySpark."""
