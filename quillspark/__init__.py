"""quillspark: a PySpark-native engine for evidence retrieval, grounded
answers and their evaluation over large document collections."""
