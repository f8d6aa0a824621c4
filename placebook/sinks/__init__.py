"""Writing registers and counting what went through."""
