"""Training-data operators over text tables.

Nothing else in the library imports this subpackage; the registry in
``__spark_entry__.py`` adds its queries only when it can be imported.
"""
