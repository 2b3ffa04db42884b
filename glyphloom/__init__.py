"""glyphloom: typing and text analytics on Spark.

Subpackages: ``functions`` (column builders), ``sources`` (readers and sinks),
``operators`` (relational operators), ``plans`` (compositions) and
``streaming`` (stateful keystroke processing).  Nothing here imports the
``llm`` subpackage, which holds the corpus operators.
"""

__version__ = "0.1.0"
