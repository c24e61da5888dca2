"""wirespan: bit-range dependency graphs and corpus preparation on Spark."""
