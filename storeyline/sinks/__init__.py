"""Texts that drawings and models are written as."""
