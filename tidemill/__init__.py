"""A PySpark-native analytics engine: relational operators, functions, SQL, versioned tables and streams as
declarative DataFrame plans."""
