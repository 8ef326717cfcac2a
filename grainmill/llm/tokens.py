"""Token ids of whole texts by a public tokenizer, without tokenizing a word twice."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

from grainmill.llm.common import travels

travels(__name__)

#: The id that ends each document.
END = 2
#: Distinct parts kept by a worker, about 120 MB at most; parts beyond are encoded each time they come.
MAX_PARTS = 1 << 19


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_bytes(path: str) -> Callable[[str | None], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers, by encode(text, add_special_tokens=False).

    Neither tokenizer here lets a token cross the place before a single blank or around a single line break, so
    such texts are encoded in these parts, each distinct part once. All other texts are encoded whole.
    """
    # A task has one core; threads for a batch of words cost as much CPU time again. Only a setting made before is kept.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    # A worker process serves many tasks; what one of them has encoded is kept where the next can find it.
    kept = vars(tokenizers).setdefault("_grainmill", {})
    if path not in kept:
        tokenizer = tokenizers.Tokenizer.from_file(path)

        # Arrays of C integers are in the machine's order; on all machines that Spark runs on that is little-endian.
        def encoded(texts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        kept[path] = encoded, {}
    encoded, known = kept[path]
    # White space beside white space or at an end, by the widest meaning of white space.
    joined = re.compile(r"[\s\x1c-\x1f\x85​﻿]{2}|^\s|\s\Z")

    def ids(text: str | None) -> bytes:
        if not text:
            return b""
        if "\0" in text or joined.search(text):
            return encoded([text])[0]
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        new = list(set(parts).difference(known))
        fresh = dict(zip(new, encoded(new), strict=True)) if new else {}
        if len(known) + len(fresh) <= MAX_PARTS:
            known.update(fresh)
            return b"".join(map(known.__getitem__, parts))
        return b"".join([known[p] if p in known else fresh[p] for p in parts])

    return ids
