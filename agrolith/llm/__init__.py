"""Operators for preparing training data: ten independent operators over documents and conversations.

Nothing outside this subpackage imports it.
"""
