"""DataFrame operators and the registered queries."""
