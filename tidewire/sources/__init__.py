"""Feed readers and the vector store."""
