"""Byte-level BPE over whole texts: the ids of ``tokenizers``, computed by the faster ``tiktoken``.

Both libraries read the same vocabulary (one as JSON, one as ranks). They cut pre-tokens with
different regular-expression engines, so a text with characters whose class could differ between
Unicode versions, or with the string of a special token, goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import array
import base64
import os
import re
from functools import cached_property, lru_cache

import numpy as np

_UNSURE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ]|<\|")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``, little-endian 32-bit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.fast = None
        ranks_path = re.sub(r"\.json$", ".tiktoken", path)
        if ranks_path != path and os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Read when a text needs it: beside the ranks it would double a worker's memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or _UNSURE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array.array("I", self.fast.encode_ordinary(text)).tobytes()

    @property
    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes behind each id."""
        if not hasattr(self, "_lengths"):
            n = self.tokenizer.get_vocab_size()
            pieces = (self.tokenizer.id_to_token(i) or "" for i in range(n))
            special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            # Byte-level pieces spell every byte as one character; special tokens are plain text.
            self._lengths = np.array([len(p.encode()) if i in special else len(p) for i, p in enumerate(pieces)], np.int64)
            if self.fast is not None:
                del self.tokenizer
        return self._lengths


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
