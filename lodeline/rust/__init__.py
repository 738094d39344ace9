"""A Rust front end of our own: lexer, parser and fact rows, run inside Spark over (path, content)."""
