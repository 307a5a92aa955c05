"""Training-data operators: one module for each of the eight problems.

Nothing outside this subpackage imports it.  ``queries.py`` lists the ``pN_`` queries and
``oracle.py`` the SQL that checks those which SQL can express.
"""
