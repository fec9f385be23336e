"""folioscope: publication-audit analytics expressed as Spark DataFrame operators."""
