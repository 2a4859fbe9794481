"""Tables with vector columns on shared storage, and the client API over them."""
