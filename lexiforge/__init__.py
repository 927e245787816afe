"""lexiforge: Spark-native building blocks for multilingual language-model corpora."""
