"""Part of meridia: operators."""
