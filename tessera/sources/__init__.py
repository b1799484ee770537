"""Generated and stored inputs, and sinks."""
