"""A PySpark-native analytics engine: a catalogue of operators, sources, functions and streams."""
