"""DataFrame to DataFrame operators over slot series."""
