"""repovigil: security analytics over large collections of source repositories, on PySpark."""
