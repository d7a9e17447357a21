"""Column expressions and the driver-side twins of some of them."""
