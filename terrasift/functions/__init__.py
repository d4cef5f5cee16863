"""terrasift functions."""
