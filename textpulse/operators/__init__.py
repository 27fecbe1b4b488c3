"""DataFrame operators (DataFrame -> DataFrame), composed from Spark built-ins."""
