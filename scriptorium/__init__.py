"""scriptorium: a Spark-native engine for document corpora.

Every public operator takes DataFrames and returns a lazy DataFrame; plans are
declared with DataFrame/SQL expressions so that Catalyst picks the physical
strategy.
"""

__version__ = "0.1.0"
