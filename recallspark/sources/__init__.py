"""Table access and file sinks."""
