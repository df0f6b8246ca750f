"""Column functions: each takes Columns and gives a Column, all inside the JVM."""
