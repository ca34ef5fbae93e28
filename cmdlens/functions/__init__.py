"""Scalar column functions (all native Spark expressions)."""

from .category import category, category_of_program
from .hashing import b64_decode, b64_encode, command_hash
from .ngrams import distinct_trigrams, trigrams, trigrams_of
from .text import (byte_length, byte_levenshtein, byte_view, edit_threshold, program_name,
                   shell_tokens, split_keywords)
from .timefmt import heat_level, relative_time

__all__ = ["category", "category_of_program", "b64_decode", "b64_encode", "command_hash",
           "distinct_trigrams", "trigrams", "trigrams_of", "byte_length", "byte_levenshtein",
           "byte_view", "edit_threshold", "program_name", "shell_tokens", "split_keywords",
           "heat_level", "relative_time"]
