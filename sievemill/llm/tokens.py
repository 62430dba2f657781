"""Token ids of whole texts by public tokenizer files, in Arrow batches."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: White space as the pre-tokenizer's regular expression knows it (fixed values).
_WS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Between two white-space characters of a run of which the second is followed by something else.
_CUT = re.compile(f"(?<=[{_WS}])(?=[{_WS}][^{_WS}])")
#: The byte-level pre-tokenizer's pattern without its look-ahead: the same pieces, where texts are cut at ``_CUT``.
_PIECES = r"'(?:[stmd]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
_SEPARATOR, _SEPARATOR_ID = "\x00", 1 << 20


class Encoder:
    """Ids of a text as unsigned 32-bit numbers, as ``tokenizers`` gives them from the file ``path`` with
    add_special_tokens=False. ``ranks``: the same vocabulary of a byte-level BPE as a ranks file, by which most texts are
    encoded several times faster; texts with a special token's string or a zero character take ``path``."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(path)
        special = [t.content for t in self._exact.get_added_tokens_decoder().values()]
        self._odd = re.compile("|".join(map(re.escape, [_SEPARATOR, *special])))
        self._fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=merges, special_tokens={_SEPARATOR: _SEPARATOR_ID})._core_bpe.encode_to_tiktoken_buffer

    def ids(self, text: str) -> np.ndarray:
        if self._fast is None or self._odd.search(text):
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if _CUT.search(text):
            found = np.frombuffer(self._fast(_CUT.sub(_SEPARATOR, text), {_SEPARATOR}), np.uint32)
            return found[found != _SEPARATOR_ID]
        return np.frombuffer(self._fast(text, set()), np.uint32)


_loaded: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """The encoder of these files, loaded once in a worker."""
    if (path, ranks) not in _loaded:
        _loaded[path, ranks] = Encoder(path, ranks)
    return _loaded[path, ranks]
