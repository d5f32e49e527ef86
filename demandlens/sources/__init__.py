"""Sources and sinks: table scans, bindings of the test tables, writers."""
