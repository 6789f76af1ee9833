"""Sources and sinks: dated snapshots of JSON, ledgers of JSON lines, tables by date."""
