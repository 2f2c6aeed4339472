"""The query catalogue, its input views and the step pipeline."""
