"""Training-data operators: filters, tokenisers, joins and searches over text and vectors.

Nothing outside this folder imports it.  Each module holds one operator with its own general
interface; :mod:`waveloom.llm.queries` has the thin registered queries.
"""
