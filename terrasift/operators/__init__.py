"""terrasift operators."""
