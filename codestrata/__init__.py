"""Code-intelligence analytics on PySpark: typed code entities, graphs, history and retrieval as DataFrame operators."""
