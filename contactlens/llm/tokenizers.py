"""Where the public tokenizer files lie: a parameter, never a copy in this repository."""

from __future__ import annotations

import os

FOLDER = "/opt/tokenizers"


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a tokenizer file in ``folder`` (or ``CONTACTLENS_TOKENIZERS``, or the default folder)."""
    return os.path.join(folder or os.environ.get("CONTACTLENS_TOKENIZERS", FOLDER), name)
