"""Training-data operators: ten corpus jobs beside the test-feedback library."""
