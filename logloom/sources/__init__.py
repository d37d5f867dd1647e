"""Readers: JSONL session logs, log lineage and tabular adapters."""
