"""Readers and writers of books: container, package document, navigation, pages."""
