"""Operators for preparing large text corpora.

Nothing outside this folder imports it.  Each module holds one operator with
its own DataFrame interface; :mod:`waveforge.llm.queries` derives the thin
``opN_<name>`` queries and their SQL from them.
"""
