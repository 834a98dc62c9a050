"""Where vocabulary files of public tokenizers lie. They are installed on every node, never copied here."""

from __future__ import annotations

import os

BYTE_BPE = "byte_bpe_50k.json"
FOLDER = "/opt/tokenizers"


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """The file in ``folder`` if one is given, else in the installed package of vocabularies or, without that, in ``FOLDER``."""
    if folder is None:
        try:
            import public_tokenizers
        except ImportError:
            folder = FOLDER
        else:
            return str(public_tokenizers.path(name))
    return os.path.join(folder, name)
