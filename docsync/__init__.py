"""Keep two large keyed document tables in step, and prove that they are."""
