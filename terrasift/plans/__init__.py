"""terrasift plans."""
