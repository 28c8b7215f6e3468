"""DataFrame -> DataFrame operators over traces."""
