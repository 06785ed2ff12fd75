"""Column expressions with pandas/numpy/Python semantics (IEEE division,
half-even rounding, strip, repr, labels), exact bounded-memory quantiles,
and the Student t distribution."""
