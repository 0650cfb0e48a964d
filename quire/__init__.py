"""quire: text-corpus and event analytics expressed as Spark DataFrame plans."""
