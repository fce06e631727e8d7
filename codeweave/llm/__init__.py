"""Operators of a training-data pipeline.  Nothing else in the library imports
this subpackage; ``__spark_entry__`` adds its queries only when it is there."""
