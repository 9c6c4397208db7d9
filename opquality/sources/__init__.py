"""Reading, column resolution, profiling and writing."""
