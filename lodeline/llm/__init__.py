"""Training-data pipeline operators.

Each module holds one operator with its own general interface; ``contract``
holds the thin ``opN_*`` queries, ``oracle`` the DuckDB SQL beside them.
Nothing outside this subpackage imports it.
"""
