"""Analyzers: text to terms, in the JVM where functions can say it, else by an Arrow function over tokenised text."""
