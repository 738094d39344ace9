"""Sources: Rust source trees, crates, configuration."""
