"""terrasift: point-location cleaning, matching and corpus operators on PySpark."""
