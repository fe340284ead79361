"""Phrase discovery and case assembly over large text archives, on Spark."""
