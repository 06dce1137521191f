"""streaming of kinfold."""
