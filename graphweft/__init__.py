"""graphweft: graph-relational analytics and graph learning as Spark DataFrame plans."""
