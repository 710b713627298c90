"""Jobs: DataFrames and parameters in, DataFrames out; time comes in as ``as_of``."""
