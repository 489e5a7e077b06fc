"""Part of meridia: plans."""
