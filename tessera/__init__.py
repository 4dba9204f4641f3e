"""tessera: Spark-native operators for vision-language training data.

DataFrame-in / DataFrame-out operators over conversation corpora, grounding
and trajectory records, feature caches, step logs, weight catalogs and
evaluation responses.  Everything is expressed with Spark SQL expressions
first; Arrow (pandas) functions are used only where a user-supplied model
or tokenizer must run, or for one exact number format.
"""

__version__ = "0.1.0"
