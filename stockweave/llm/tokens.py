"""Token ids of whole texts for a public byte-level vocabulary, as little-endian 32-bit bytes.

tiktoken, which has the same vocabulary as ranks, encodes a text as a whole. A text that holds the
string of the special token goes to `tokenizers` itself, which reads that string as the token.
"""

from __future__ import annotations

from functools import cache
from struct import pack

import numpy as np

_SPECIAL = "<|endoftext|>"


class Encoder:
    def __init__(self, ranks_path: str, tokenizer_path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._tokenizer_path = tokenizer_path
        self._slow = None
        self.ends_sentence, self.starts_gap = self._kinds(ranks)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _kinds(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Per id: its bytes end a sentence; its bytes begin with white space."""
        ends, gap = np.zeros(max(ranks.values()) + 2, bool), np.zeros(max(ranks.values()) + 2, bool)
        for token, i in ranks.items():
            ends[i] = token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?") or b"\n" in token
            gap[i] = token[:1] in (b" ", b"\n", b"\r", b"\t")
        return ends, gap

    def encode(self, text: str) -> bytes:
        if _SPECIAL in text:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._tokenizer_path)
            return self._bytes(self._slow.encode(text, add_special_tokens=False).ids)
        return self._bytes(self._fast.encode_ordinary(text))


@cache
def encoder(ranks: str, tokenizer: str) -> Encoder:
    """One encoder a worker; files are named as in the folder of public tokenizers, or by path."""
    import os

    import public_tokenizers

    return Encoder(*(f if os.path.isabs(f) else public_tokenizers.path(f) for f in (ranks, tokenizer)))
