"""Streaming forms of ordered operators (an extension: bounded inputs need none of them)."""
