"""Landing, normalisation, configuration tables and sinks."""
