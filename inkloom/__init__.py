"""inkloom: print separation, screening and job analytics as Spark DataFrame transforms."""
