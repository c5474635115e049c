"""The jobs: DataFrames in, one DataFrame out, nothing run until the caller acts."""
