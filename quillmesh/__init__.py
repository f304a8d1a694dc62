"""quillmesh: a Spark-native analytics engine for message archives."""
