"""Message, lab-row, reference-data sources and result sinks."""
