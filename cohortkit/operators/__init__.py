"""DataFrame-in, DataFrame-out cohort operators."""
