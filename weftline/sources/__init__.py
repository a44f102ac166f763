"""Sources and sinks by format, from files and over HTTP."""
