"""Tables as bit and integer vectors."""
