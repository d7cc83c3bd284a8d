"""Training-data operators: ten building blocks of a corpus pipeline.

Nothing else in the library imports this package; ``__spark_entry__.py`` adds
its queries (:mod:`linkflow.llm.queries`) when the package can be imported.
"""
