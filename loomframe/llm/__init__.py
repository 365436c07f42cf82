"""Training-data operators.  Nothing else in ``loomframe`` imports this subpackage."""
