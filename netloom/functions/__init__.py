"""Column expressions: addresses, object identifiers, capabilities, vendors, risk."""
