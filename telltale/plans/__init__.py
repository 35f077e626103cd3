"""End-to-end jobs composed of the operators, each one lazy plan."""
