"""Jobs: result documents, the result log, chart series, full runs."""
