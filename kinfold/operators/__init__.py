"""operators of kinfold."""
