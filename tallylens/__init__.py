"""tallylens: tally-sheet audit analytics and corpus preparation on PySpark."""
