"""tidewatch: code-security analytics expressed as Spark DataFrame plans."""
