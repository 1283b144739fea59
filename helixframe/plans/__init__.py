"""Parameters of a correction run and how reads are grouped into units of work."""
