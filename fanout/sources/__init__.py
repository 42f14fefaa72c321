"""Reading and writing: tables, files, logs, framed messages, sinks."""
