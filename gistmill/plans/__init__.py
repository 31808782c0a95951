"""Plans over the operators: compression, stores, chats, audits; the registry of queries."""
