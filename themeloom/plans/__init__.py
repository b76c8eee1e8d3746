"""Jobs of several steps and how their data is laid out."""
