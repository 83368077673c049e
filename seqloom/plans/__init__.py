"""Parameters and whole clusterings."""
