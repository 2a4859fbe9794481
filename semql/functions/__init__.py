"""Column functions: vectors, embeddings, collations and SQLite-style scalars."""
