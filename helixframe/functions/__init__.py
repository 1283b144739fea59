"""Column functions: built-in expressions over sequences, qualities, CIGAR strings and headers."""
