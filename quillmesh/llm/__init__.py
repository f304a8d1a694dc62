"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
