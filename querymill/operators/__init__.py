"""DataFrame operators over candidate pools, evidence, catalogs, documents and embeddings."""
