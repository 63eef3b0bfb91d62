"""Position traces and usage as streams."""
