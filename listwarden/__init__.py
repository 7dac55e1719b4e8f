"""Check observed items against allow-lists on Spark, with the option to say "not sure"."""
