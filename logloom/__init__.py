"""Session-log analytics for Spark: event ledgers, turns, tool calls, token usage."""
