"""The fold as a streaming operator."""
