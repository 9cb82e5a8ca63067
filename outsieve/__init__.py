"""outsieve: a Spark-native engine that inspects outbound text at corpus scale."""
