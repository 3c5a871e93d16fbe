"""Network-flow behavioural analytics expressed as Spark DataFrame plans."""
