"""Token ids of texts, the same that the public byte-level tokenizer file gives.

The ids come from the same vocabulary and merges in their fast form; texts that hold one of the
file's special tokens, which are matched before anything else, go through the file's own tokenizer.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

END = 1


class Encoder:
    """ids of a text by a tokenizer file (.json) whose ranks (.tiktoken) lie beside it."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        self.path = path
        with open(path, "rb") as whole:
            special = [t["content"] for t in json.load(whole)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.size = len(ranks) + len(special)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        """The file's own tokenizer, for the texts that need it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids, with END after the last."""
        text = text or ""
        if self.special and self.special.search(text):
            found = self.whole.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.array([*found, END], "<u4")


@lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    """One for each process; path defaults to the public byte-level file of 50,257 ids."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
