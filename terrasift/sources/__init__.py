"""terrasift sources."""
