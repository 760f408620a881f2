"""Tables that outlive a query: atomic commits, versioned snapshots, the lexical index, trigram postings."""
