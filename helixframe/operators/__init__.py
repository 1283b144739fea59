"""Operators: seeds and anchors, support, scheduling, consensus, correction, evaluation."""
