"""Training-data operators over documents and embeddings; nothing outside this subpackage imports it."""
