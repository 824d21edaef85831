"""The query catalog: table views over the test data, queries, check SQL."""
