"""Results kept up to date over streams of edges."""
