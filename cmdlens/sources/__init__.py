"""Sources and sinks: line logs, tool-call JSON, encoded history, test-table fixtures."""
