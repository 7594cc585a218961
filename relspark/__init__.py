"""relspark: relational logic, Datalog and corpus operators on Spark DataFrames."""
