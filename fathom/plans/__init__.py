"""Plan building blocks and the registered queries."""
