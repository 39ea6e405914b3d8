"""Training-data operators: quality, mixing, tokenisation, privacy and near-duplicate removal.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``registry`` wraps them as the ``opN_*`` queries.
"""
