"""Column-level and keyed building blocks shared by the operators."""
