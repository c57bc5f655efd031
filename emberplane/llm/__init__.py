"""Corpus-preparation operators; nothing else in emberplane imports this subpackage."""
