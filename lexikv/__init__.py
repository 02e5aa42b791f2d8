"""lexikv: Spark-native analytics for key-value data held under dictionary compression."""
