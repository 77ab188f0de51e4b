"""ctxspark: a PySpark-native analytics engine for code- and document-knowledge stores."""
