"""graphloom: graph analytics as Spark DataFrame programs."""
