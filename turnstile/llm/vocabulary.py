"""Where the public vocabularies lie; every operator takes the path as a parameter."""

from __future__ import annotations


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
