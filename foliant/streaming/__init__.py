"""New documents as they arrive, through the same operators."""
