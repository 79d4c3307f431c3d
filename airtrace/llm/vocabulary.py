"""Where the vocabulary files of public tokenizers are."""

from __future__ import annotations

import os


def word_bpe(name: str = "word_bpe_49k.json") -> str:
    """Path of the word-level vocabulary; TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
