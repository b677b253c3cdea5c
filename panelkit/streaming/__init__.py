"""Jobs over what arrives bit by bit."""
