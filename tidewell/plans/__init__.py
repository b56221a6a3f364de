"""Whole plans made of operators: ingest, browse, dedupe, digest, reports."""
