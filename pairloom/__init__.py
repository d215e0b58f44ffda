"""pairloom: Spark-native operators for building and scoring minimal-change image-text pair data."""
