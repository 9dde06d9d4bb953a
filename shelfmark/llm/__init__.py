"""Training-data operators: labelling, deduplication, sharding and packing of document tables.

Nothing else in the library imports this subpackage.  Every operator selects the columns it needs first, so
extra columns of any name are ignored unless its docstring says that they are kept.
"""
