"""quern: document-retrieval analytics as DataFrame plans."""
