"""Reading and writing tables and manifests."""
