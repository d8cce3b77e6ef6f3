"""Column builders: cell values, aggregates, hydraulic formulas."""
