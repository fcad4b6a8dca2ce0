"""Training-data operators over a documents table.

Every operator selects the columns it needs (``doc_id``, ``text``), so extra
columns of any name pass by untouched. Nothing outside this package imports it.
"""
