"""Operators that turn raw documents, vectors and pages into training data.

Nothing outside this package imports it. Each module holds one operator with its own general
interface; ``queries`` derives the registered result columns from them.
"""
