"""Operators for large training-data pipelines. Nothing else in quillstack imports this subpackage."""
