"""A PySpark-native analytics engine for camera-based gate inspection."""
