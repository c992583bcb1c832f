"""Training-data operators: ten first-class components over documents, pages, vectors and conversations.

Nothing outside this subpackage imports it. `queries` holds the thin registered queries, `oracles` their SQL.
"""
