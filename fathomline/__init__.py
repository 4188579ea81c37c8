"""fathomline: a Spark-native engine for indexing and querying developer text.

Sub-packages
------------
functions  column-level building blocks (instants, text, identifiers)
sources    readers, incremental loading, state tables
operators  relational operators that Spark has no single built-in for
plans      query plans built from the operators (what ``__spark_entry__`` registers)
streaming  Structured Streaming forms of the incremental operators
llm        training-data operators; nothing else in the library imports it
"""
