"""Training-data operators: each module holds one operator, `queries` wires them to the test tables."""
