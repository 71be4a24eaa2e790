"""nodeloom: graph and point-cloud analytics as Spark DataFrame plans."""
