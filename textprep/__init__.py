"""textprep: Spark-native preparation and evaluation of text datasets."""
