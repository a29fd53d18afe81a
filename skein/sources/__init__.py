"""Readers: source trees, code, Markdown and knowledge bundles."""
