"""Commands for spark-submit."""
