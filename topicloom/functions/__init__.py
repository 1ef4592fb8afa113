"""Column expressions: text, vectors of topic counts, sampling."""
