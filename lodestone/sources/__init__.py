"""Tables, file formats and sinks."""
