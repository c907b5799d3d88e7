"""Token ids of whole texts, as the tokenizer library gives them."""

from __future__ import annotations

import re

import numpy as np

#: The vocabulary's only special string; the library replaces it inside texts.
SPECIAL = "<|endoftext|>"
#: Characters of which both libraries hold the same classes for certain; other texts take the slower library.
_UNUSUAL = re.compile(r"[^\t\n\r -~\xa1-ɏ‐-‧]")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Text to ids, equal to tokenizers' encode(text, add_special_tokens=False).

    The same vocabulary is at hand as ranks for tiktoken, whose encoder is four times as fast. It takes the texts
    of common characters without the special string; every other text goes to the tokenizers library itself.
    """

    def __init__(self, library: str, ranks: str | None = None):
        self.path, self.loaded = library, None  # most workers never need the library itself
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @property
    def library(self):
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
        return self.loaded

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.fast is None or SPECIAL in text or _UNUSUAL.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


#: One encoder in each Python worker.
made: dict[tuple, Ids] = {}


def ids(library: str, ranks: str | None = None) -> Ids:
    return made.get((library, ranks)) or made.setdefault((library, ranks), Ids(library, ranks))
