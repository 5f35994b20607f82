"""Spark jobs for test-feedback analytics (runner output, coverage reports, repair tasks)."""
