"""Part of meridia: sources."""
