"""Analysis of places, and of the tables that describe them, as Spark DataFrame operators."""
