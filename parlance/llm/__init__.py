"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_*`` queries over the ``documents`` and ``pages`` tables, ``oracles`` the
SQL they are compared with.
"""
