"""tidemark: incremental, parameterised SQL views on PySpark."""
