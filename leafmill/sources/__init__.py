"""Readers and writers of pages, passages, vectors and manifests."""
