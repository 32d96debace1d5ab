"""Operators for corpora that language models are trained on.

Nothing outside this subpackage imports it; deleting it leaves the rest whole.
"""
