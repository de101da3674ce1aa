"""quire: a PySpark-native analytics engine over corpora of PDF files."""
