"""DataFrame -> DataFrame operators over long (symbol, date) and text tables."""
